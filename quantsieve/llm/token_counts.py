r"""Token counts of texts: encoded in batches inside Arrow functions, which return lengths and no ids.

Texts are taken in runs of about ``BATCH_BYTES`` bytes, whatever their number, so that a few long texts and many short ones
cost a task the same memory. A text of more than ``span`` bytes is cut into several first: at the strings of added tokens,
which the library takes out before all else, and where ``encoding.cuts`` shows that no token can cross. The counts
of a text's cuts sum to its own. A text without such a place, and every text of a tokenizer that ``encoding`` doesn't
know by heart, stays whole.

``.json`` files are the tokenizers library's; ``.model`` files go to sentencepiece, whole text by whole text.

Defined results: a null text counts as empty: no bytes, no tokens; every row is counted, null and repeated ids included;
an empty table gives no rows; of the columns of docs only those of ``keep`` are returned, and one of these that is
named like a result is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quantsieve.llm.encoding import _SPACES, BATCH_BYTES, Encoder, cuts, encoder

#: Bytes of a text beyond which it is cut.
SPAN = 1_000_000
#: Bytes that are searched for a cut at first.
_LOOK = 4096
RESULTS = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}


def _places(b: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Places in b[start:stop] where one cut may stand alone. One right after white space needs another before that."""
    part = b[start:stop]
    may = cuts(part, np.array([len(part)]))
    may[1:] &= ~_SPACES[part[:-1]] | _SPACES[part[1:]]
    return np.flatnonzero(may) + start


def _last_cut(b: np.ndarray, lo: int, at: int, hi: int) -> int:
    """The last place up to ``at`` where b[lo:hi], a text of its own, may be cut; the first one after it if there is none; else hi."""
    look = _LOOK
    while True:
        start, stop = max(lo, at - look), min(hi, at + 2)
        found = _places(b, start, stop)
        # The first places of a slice don't see what stands before them, unless the text begins there.
        found = found[(found > (start + 2 if start > lo else lo)) & (found <= at)]
        if len(found):
            return int(found[-1])
        if start == lo:
            break
        look *= 8
    while at < hi:
        start, stop = max(lo, at - 2), min(hi, at + SPAN)
        found = _places(b, start, stop)
        found = found[(found > at) & ((found < stop - 1) | (stop == hi))]
        if len(found):
            return int(found[0])
        at = stop if stop == hi else stop - 2
    return hi


def inner_cuts(enc: Encoder, b: np.ndarray, lo: int, hi: int, span: int) -> list[int]:
    """Places inside the text b[lo:hi] where it is cut, so that no part is longer than span bytes if that can be."""
    out, parts = [], [(lo, hi)]
    if enc.added:
        strings = re.compile(b"|".join(re.escape(s) for s in sorted(enc.added, key=len, reverse=True)))
        edges = [lo, *(lo + x for m in strings.finditer(b[lo:hi].tobytes()) for x in m.span()), hi]
        out = [x for x in edges if lo < x < hi]
        # What stands between two strings, and not the strings themselves.
        parts = list(zip(edges[0::2], edges[1::2], strict=True))
    for at, to in parts:
        while to - at > span:
            at = _last_cut(b, at, at + span, to)
            if at < to:
                out.append(at)
    return sorted(set(out))


def counts(enc: Encoder, texts: pa.Array, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    n_bytes = np.diff(ends)
    inner = [x for i in np.flatnonzero(n_bytes > span) for x in inner_cuts(enc, data, int(ends[i]), int(ends[i + 1]), span)] if enc.local else []
    starts = np.sort(np.concatenate([ends[:-1], np.array(inner, "<i8")]), kind="stable")
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, ends[-1:]).astype("<i8")), pa.py_buffer(data))
    per = np.concatenate([np.zeros(0, np.int64), *(n for _, n in enc.encode(units))])
    # Empty texts begin where their successor does; inner cuts never stand at a text's beginning.
    first = np.arange(len(texts)) + np.searchsorted(np.array(inner, "<i8"), ends[:-1])
    total = np.concatenate(([0], np.cumsum(per)))
    return n_bytes, total[np.append(first[1:], len(starts))] - total[first] if len(texts) else n_bytes


def _by_sentencepiece(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    import sentencepiece

    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    model, out, at = sentencepiece.SentencePieceProcessor(model_file=path), [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, side="right")) - 1)
        out += map(len, model.encode(texts.slice(at, to - at).to_pylist(), num_threads=1))
        at = to
    return np.diff(ends), np.array(out, np.int64)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, *, keep: Sequence[str] = ("doc_id",), special_strings: bool = True, span: int = SPAN, text: str = "text") -> DataFrame:
    """keep, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens) of every row; a narrow step without a shuffle."""
    if clash := set(keep) & set(RESULTS):
        raise ValueError(f"kept columns are named like results: {', '.join(sorted(clash))}")
    rows = docs.select(*keep, docs[text].alias("_qs_text"))
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in RESULTS.items())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("_qs_text")
            n_bytes, n = _by_sentencepiece(tokenizer_path, found) if tokenizer_path.endswith(".model") else counts(encoder(tokenizer_path, special_strings), found, span)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [*keep, *RESULTS])

    return rows.mapInArrow(count, schema)
