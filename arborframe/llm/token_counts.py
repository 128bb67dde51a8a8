"""Token counts per section by offset-mapped attribution.

A document is encoded once, as a whole, with a byte-level BPE vocabulary. As
every token of it stands for a known number of bytes, the running sum of these
lengths maps each token to its span of UTF-8 bytes. The spans are then joined
to the sections' intervals by binary search. Sections are the document's lines
(with their line end), or the given fields laid end to end.

A token that crosses a boundary is allocated by the rule:
  "start"   to the section that holds its first byte;
  "most"    to the section that holds most of its bytes (ties: the earlier);
  "share"   to all of them, in proportion to their bytes.
Whatever the rule, a document's counts sum to the tokens of its whole text.

Defined cases: null and empty texts have one empty section without tokens;
repeated documents are counted each; special tokens' strings are ordinary text.
The encoder's regular expression overflows its stack on runs of white space of
about a million characters, so those of LONG and more are handed over beside
it, as the one piece that the expression makes of them: no token differs.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG = 5_000
#: What \s is in the encoder's expression (Python's has control characters besides).
_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tokenizer and the length in bytes of each of its tokens, loaded once in a worker."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        lengths[k] = len(token)
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(enc, text: str) -> np.ndarray:
    parts, at = [], 0
    for m in _SPACES.finditer(text) if len(text) >= LONG else ():
        end = m.end() - (m.end() < len(text))  # the last space goes with what follows it
        parts += [enc.encode_ordinary(text[at : m.start()]), enc._encode_single_piece(text[m.start() : end])]
        at = end
    return np.concatenate([np.array(p, np.int64) for p in [*parts, enc.encode_ordinary(text[at:])]])


def line_ends(raw: bytes) -> np.ndarray:
    """Ends of the lines of a text, in bytes; the last is the text's end."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, and how many tokens cross into another section."""
    starts = np.concatenate([[0], token_ends[:-1]])[: len(token_ends)]
    n = len(section_ends)
    first = np.minimum(np.searchsorted(section_ends, starts, side="right"), n - 1)
    last = np.minimum(np.searchsorted(section_ends, token_ends, side="left"), n - 1)
    crossing = np.flatnonzero(last > first)
    counts = np.bincount(first, minlength=n).astype(np.float64)
    if rule != "start":
        lower = np.concatenate([[0], section_ends[:-1]])
        for t in crossing:
            own = np.arange(first[t], last[t] + 1)
            share = np.minimum(section_ends[own], token_ends[t]) - np.maximum(lower[own], starts[t])
            counts[first[t]] -= 1
            if rule == "share":
                counts[own] += share / share.sum()
            else:
                counts[own[int(share.argmax())]] += 1
    return counts, np.bincount(first[crossing], minlength=n)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", fields: list[str] | None = None, rule: str = "start", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document and section: key, section (from 0; or the field's name), start_byte, end_byte, n_tokens, n_crossing.

    With fields, each field of the row is a section of the text made of all of them in turn.
    """
    if rule not in ("start", "most", "share"):
        raise ValueError(rule)
    whole = free_name(docs.columns, "__whole")
    many = free_name(docs.columns, "__fields")
    parts = [F.coalesce(F.col(f), F.lit("")) for f in fields or [text]]
    source = docs.select(F.col(key).alias("__key"), F.concat(*parts).alias(whole), F.array(*[F.octet_length(p) for p in parts]).alias(many))
    key_type = docs.schema[key].dataType
    number = T.DoubleType() if rule == "share" else T.LongType()
    schema = T.StructType([T.StructField(key, key_type), T.StructField("section", T.StringType() if fields else T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start_byte", "end_byte")), T.StructField("n_tokens", number), T.StructField("n_crossing", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(vocabulary)
        for big in batches:
            for batch in slices(big, whole):
                rows, section, start, end, tokens, crossing = [], [], [], [], [], []
                for i, (t, sizes) in enumerate(zip(batch.column(whole).to_pylist(), batch.column(many).to_pylist(), strict=True)):
                    ends = np.cumsum(np.array(sizes, np.int64)) if fields else line_ends(t.encode())
                    n, over = allocate(np.cumsum(lengths[encode(enc, t)]), ends, rule)
                    rows.append(np.full(len(ends), i))
                    section.append(np.array(fields, object) if fields else np.arange(len(ends)))
                    start.append(np.concatenate([[0], ends[:-1]]))
                    end.append(ends)
                    tokens.append(n)
                    crossing.append(over)
                at = pa.array(np.concatenate(rows))
                made = [batch.column("__key").take(at), *(pa.array(np.concatenate(x)) for x in (section, start, end, tokens, crossing))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(made, arrow.types, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return source.mapInArrow(run, schema)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs)
