"""Token counts by section (operator 1): offset-mapped attribution.

A document is encoded once, as a whole. The bytes of its tokens, laid end to
end, are the document, so sums of token lengths are the tokens' spans. Spans
are interval-joined to the sections by binary search, and tokens that cross a
section's bound are allotted by one of two rules: to the section in which the
token starts (``"start"``), or in which it ends (``"end"``). Beside that count
stands the share: each token counts by the part of its bytes in the section.
For sections that tile the document, both sum to the document's tokens.

Style: Arrow batches; encoding has no SQL form. No shuffle for line sections;
for given sections, one join by ``doc_id``.

Defined results
---------------
null text: as an empty one. Empty text: one empty section with no tokens (line
sections), or what the given sections say, with no tokens. Sections may
overlap, leave gaps, be empty or reach over the end (they are cut to it).
Repeated ids and rows: each row is counted by itself. Documents without given
sections don't appear, so none with a null ``doc_id``, which no section can name. Extra columns are dropped. Empty tables give an empty
result. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "doc_id long, section long, start long, end long, tokens long, token_share double, crossing long, doc_tokens long"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_coders: dict[int, tuple] = {}


def _coder(ranks: bytes, pattern: str) -> tuple:
    """The encoding, and the byte length of each token; kept while the worker lives."""
    key = zlib.crc32(ranks + pattern.encode())
    if key not in _coders:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            lengths[rank] = len(token)
        _coders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths
    return _coders[key]


def line_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines, each with its line feed."""
    ends = np.flatnonzero(data == 10) + 1
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    return np.concatenate(([0], ends[:-1])), ends


def join_spans(ends: np.ndarray, lengths: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sections [low, high) in bytes: tokens by the rule, by share, and how many cross one of the section's bounds."""
    starts = ends - lengths
    highs = np.maximum(lows, highs)
    by = starts if rule == "start" else ends - 1
    tokens = np.searchsorted(by, highs) - np.searchsorted(by, lows)

    def filled(at: np.ndarray) -> np.ndarray:
        """Tokens, with fractions, up to a byte."""
        k = np.searchsorted(ends, at, side="right")
        part = np.zeros(len(at))
        inside = k < len(ends)
        part[inside] = (at[inside] - starts[k[inside]]) / lengths[k[inside]]
        return k + part

    at_low, at_high = np.searchsorted(starts, lows, side="right") - 1, np.searchsorted(starts, highs, side="right") - 1
    none = len(ends) == 0
    cut = lambda k, at: np.zeros(len(at), bool) if none else (k >= 0) & (starts[k] < at) & (at < ends[k])
    low_cut, high_cut = cut(at_low, lows), cut(at_high, highs)
    crossing = low_cut.astype(np.int64) + high_cut - (low_cut & high_cut & (at_low == at_high))
    return tokens, filled(highs) - filled(lows), np.where(highs > lows, crossing, 0)


def attribute(docs: DataFrame, ranks_file: str, pattern: str, sections: DataFrame | None = None, rule: str = "start") -> DataFrame:
    """(doc_id, section, start, end, tokens, token_share, crossing, doc_tokens); start and end in code points.

    ``sections``: rows (doc_id, section, start, end) in code points; without it, the lines of each text, numbered from 0.
    """
    if rule not in ("start", "end"):
        raise ValueError(f"no such rule: {rule}")
    ranks = docs.sparkSession.sparkContext.broadcast(Path(ranks_file).read_bytes())  # a fixed vocabulary file

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, sizes = _coder(ranks.value, pattern)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in _NAMES}
            given = batch["sections"] if "sections" in batch else [None] * len(batch)
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], given, strict=True):
                text = text or ""
                data = np.frombuffer(text.encode(), np.uint8)
                lengths = sizes[coder.encode_to_numpy(text, disallowed_special=())] if text else np.zeros(0, np.int64)
                ends = np.cumsum(lengths)
                plain = len(data) == len(text)
                if spans is None:
                    lows, highs = line_bounds(data)
                    names = range(len(lows))
                    if plain:
                        low_chars, high_chars = lows, highs
                    else:
                        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                        low_chars, high_chars = chars[lows], chars[highs]
                else:
                    names = [s["section"] for s in spans]
                    low_chars = np.array([min(max(0, s["start"]), len(text)) for s in spans], np.int64)
                    high_chars = np.array([min(max(0, s["end"]), len(text)) for s in spans], np.int64)
                    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                    lows, highs = at[low_chars], at[high_chars]
                tokens, share, crossing = join_spans(ends, lengths, lows, highs, rule)
                n = len(lows)
                for name, values in zip(_NAMES, ([doc_id] * n, names, low_chars, high_chars, tokens, share, crossing, [len(ends)] * n), strict=True):
                    out[name].extend(values)
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if sections is not None:
        each = sections.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "section"))).alias("sections"))
        rows = rows.join(each, rows["doc_id"] == each["__id"]).select("doc_id", "text", "sections")
    return rows.mapInPandas(count, _SCHEMA)
