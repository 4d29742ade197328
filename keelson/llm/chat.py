"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with offsets. A turn is

    ### {role}: {text}</turn>\\n

``#``, the ``<`` of ``</turn>`` and the backslash are control characters and get a backslash in front
wherever a role or a text contains them, as does the colon in a role; dropping that backslash again gives
the text back. The sorted character spans of the assistant texts are intersected with the token spans
by binary search; a token's mask is the part of it inside such a span, so a token that straddles a border is
masked in part and the characters under the mask are the texts exactly.

The output holds what training needs (``formatted``, ``token_ids``, and per token the masked characters
``mask_start``, ``mask_end``, empty where the token has no loss); :func:`parse_turns` and :func:`masked_texts` read it back.

One conversation is one sequence for the tokenizer, so it is gathered into one row; conversations are spread over tasks
by id, and a task handles a row at a time.

Defined results: turns sort by ``turn``, nulls last, ties by role and text; repeated rows are repeated turns; a null
role or text is empty; rows with a null conversation id form one conversation; a turn without text renders as an empty
text; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = "### ", "</turn>\n"
LOSS_ROLE = "assistant"
TOKENIZER = "byte_bpe_50k.json"
_CONTROL = re.compile(r"[\\#]|<(?=/turn>)")
_ROLE_CONTROL = re.compile(r"[\\#:]|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
OUTPUT = (
    "conv_id long, formatted string, token_ids array<int>, "
    "token_start array<int>, token_end array<int>, mask_start array<int>, mask_end array<int>"
)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and the starts and ends of its assistant texts."""
    out, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{_ROLE_CONTROL.sub(r'\\\g<0>', role)}: ", escape(text)
        if role == LOSS_ROLE:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += (head, body, TAIL)
        at += len(head) + len(body) + len(TAIL)
    return "".join(out), starts, ends


def loss_mask(offsets: list[tuple[int, int]], starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Per token the characters of it that lie in a span, found by binary search over the sorted spans.

    A token over several spans covers whatever stands between them too; the template puts more
    between two texts than any token spans, and this raises if it doesn't.
    """
    low, high = [], []
    for a, b in offsets:
        first, last = bisect_right(ends, a), bisect_left(starts, b)  # spans that end after a, that start before b
        while first < last and starts[first] == ends[first]:
            first += 1
        if first >= last:
            low.append(a)
            high.append(a)
            continue
        if any(starts[k] < ends[k] for k in range(first + 1, last)):
            raise ValueError("a token spans two texts")
        low.append(max(a, starts[first]))
        high.append(min(b, ends[first]))
    return low, high


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def masked_texts(formatted: str, low: list[int], high: list[int]) -> str:
    """All text under the mask, unescaped. Tokens that share a character count it once."""
    runs: list[list[int]] = []
    for a, b in zip(low, high):
        if a >= b:
            continue
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return "".join(unescape(formatted[a:b]) for a, b in runs)


def _tokenizer(file: str):
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(file if "/" in file else public_tokenizers.path(file))
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    return tokenizer


def format_conversations(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """One row per conversation with the columns of :data:`OUTPUT`."""
    one = F.struct(
        F.col(turn).isNull().alias("last"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    whole = df.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def encode(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        ints = pa.list_(pa.int32())
        for batch in iterator:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rendered = [
                    render(list(zip(r, x)))
                    for r, x in zip(part.column("roles").to_pylist(), part.column("texts").to_pylist())
                ]
                columns: list[list] = [[], [], [], [], []]
                for (formatted, starts, ends), e in zip(
                    rendered, t.encode_batch([r[0] for r in rendered], add_special_tokens=False)
                ):
                    low, high = loss_mask(e.offsets, starts, ends)
                    for c, v in zip(columns, (e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets], low, high)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array([r[0] for r in rendered], pa.string()), *[pa.array(c, ints) for c in columns]],
                    names=["conv_id", "formatted", "token_ids", "token_start", "token_end", "mask_start", "mask_end"],
                )

    return whole.mapInArrow(encode, OUTPUT)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say when read back: turns and loss text as digests."""

    def read(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in iterator:
            rows = []
            for conv, text, low, high in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "formatted", "mask_start", "mask_end")]):
                turns = parse_turns(text)
                h = hashlib.sha256()
                for r, x in turns:
                    h.update(f"{r}\n{x}\n".encode())
                loss = masked_texts(text, low, high)
                rows.append((conv, len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return formatted.select("conv_id", "formatted", "mask_start", "mask_end").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


#: The extra conversation of the query, which quotes control strings.
EXTRA = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], "conv_id long, turn long, role string, text string"
    )
    return digests(format_conversations(table.unionByName(extra)))


SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA}'),
r AS (
  SELECT *, length('### : </turn>' || chr(10)) + length(regexp_replace(role, '[\\#:]|(</turn>)', '\\\0', 'g'))
            + length(regexp_replace(text, '[\\#]|(</turn>)', '\\\0', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
