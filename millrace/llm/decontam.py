"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, units after numbers and names (title-case words inside a sentence) turn into typed
placeholders, other words into lower case without outer marks. Windows of the benchmark's templates are rows with a hash, and
the documents' windows are joined with them by hash, after a filter of fixed size that the benchmark fills. Where windows of an
item meet those of a document, words are compared one by one. What is word for word the item's own counts as it is; elsewhere the
slots must be consistent: what stands for one value of the item is one value in the document, and different values stay
different. A question with other numbers or names is caught; a text that only has its shape is not. Windows of mostly
placeholders have too little shape for this and are looked up by their values, word for word.

The benchmark may have any size: nothing of it is collected but the filter's bits, and documents are read once for the join.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, key_texts, map_batches, materialise

#: Words of a window, and words of an item that must be met (all of a shorter item).
WINDOW, MIN_WORDS = 8, 13
#: Bits of the filter for each width of windows, as a power of two; a benchmark that fills it costs a larger join and loses nothing.
FILTER_BITS = 24
#: So many windows of the benchmark at most (some 250 bytes each) are broadcast; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 200_000
#: Words from which an item is looked for inside texts; a shorter one only as a whole text.
LEAST_WORDS = 3
#: So many ids (two longs) of documents at most are broadcast.
BROADCAST_ROWS = 1_000_000
#: Entries of a task's word cache, characters looked up together.
CACHE, CHUNK = 500_000, 500_000
#: Units that count as such after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "ml cl dl l liter liters litre litres gallon gallons pint pints cup cups "
    "v w kw mw a j kj hz khz mhz ghz b kb mb gb tb pa kpa n c f k mph kmh kph "
    "percent cent cents dollar dollars euro euros pence usd eur gbp".split()
)
_NUMBER, _UNIT, _TITLE, _STOP, _FLAGS = 1, 2, 4, 8, 15
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMERIC = re.compile(r"\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?")
_CLOSING, _STOPS = "\"')]»”’", (".", "!", "?", ":")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = {"number": np.uint64(0x1111111111111110), "unit": np.uint64(0x2222222222222220), "name": np.uint64(0x3333333333333330)}
_PLACES = frozenset(int(p) for p in _PLACE.values())


class WordCodes(dict):
    """word -> hash of its bare form with flags in the four lowest bits; 0 for a word of marks alone."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        bare = word if word.isalnum() else _EDGE.sub("", word)
        low = bare.lower()
        code = 0
        if bare:
            flags = _NUMBER * (low[0].isdecimal() and bool(_NUMERIC.fullmatch(low))) | _UNIT * (low in UNITS) | _TITLE * (bare[0].isupper() and (bare[1:].islower() or len(bare) == 1))
            if bare is not word:
                flags |= _STOP * word.rstrip(_CLOSING).endswith(_STOPS)
            code = xxhash.xxh3_64_intdigest(low) & ~_FLAGS & (1 << 64) - 1 | flags or 16
        self[word] = code
        return code


#: Stands between texts that are looked up together; it ends a sentence and is in no window of a benchmark.
_BREAK = 0x5EED5EED5EED5EE0 | _STOP


def template(text: str, cache: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the template's words (placeholders alike for their type) and the same with values kept."""
    words = text.split()
    return _template(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))


def _template(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # marks alone are no words, but may end a sentence only as part of a word
    codes = codes[codes != 0]
    flags = (codes & np.uint64(_FLAGS)).astype(np.uint8)
    value = codes & ~np.uint64(_FLAGS)
    out = value.copy()
    number = (flags & _NUMBER) > 0
    after = np.concatenate([[False], number[:-1]])
    start = np.concatenate([[True], (flags[:-1] & _STOP) > 0])[: len(codes)]
    out[((flags & _TITLE) > 0) & ~start & ~number] = _PLACE["name"]
    out[((flags & _UNIT) > 0) & after[: len(codes)]] = _PLACE["unit"]
    out[number] = _PLACE["number"]
    return out, value


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes == _PLACE["number"]) | (codes == _PLACE["unit"]) | (codes == _PLACE["name"])


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of width words."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = codes[:n] * _ODD
    for i in range(1, width):
        acc = (acc ^ (acc >> np.uint64(29))) * _ODD + codes[i : i + n]
    return acc ^ (acc >> np.uint64(32))


_WINDOW = "width int, exact boolean, hash long, place int, codes binary, words binary"
_KINDS = {"width": pa.int32(), "exact": pa.bool_(), "hash": pa.int64(), "place": pa.int32(), "codes": pa.binary(), "words": pa.binary()}


def _hashes(codes: np.ndarray, value: np.ndarray, width: int, exact: bool) -> np.ndarray:
    return windows(value if exact else codes, width)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, item_words, width, exact, hash, place, codes, words) for the windows of items (item_id, text) that are looked up:
    by their template, or exact, by their values."""

    def make():
        cache = WordCodes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, value = template(text, cache)
                n = len(codes)
                width = min(window, n)
                if not n:
                    continue
                plain = np.concatenate([[0], np.cumsum(~_slots(codes))]).tolist()
                kinds = {e: _hashes(codes, value, width, e).view(np.int64).tolist() for e in (False, True)}
                for j in range(n - width + 1):
                    # half of a window at least is words
                    shaped = 2 * (plain[j + width] - plain[j]) >= width and n >= LEAST_WORDS
                    # an item's first word may have another code inside a document's sentence
                    for exact in [False] * shaped + [True] * (not shaped or j == 0):
                        out.append((item_id, n, width, exact, kinds[exact][j], j, codes[j : j + width].tobytes(), value[j : j + width].tobytes()))
            kinds = {"item_id": pa.int64(), "item_words": pa.int32()} | _KINDS
            return pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds.values())], list(kinds))

        return step

    return map_batches(items, make, "item_id long, item_words int, " + _WINDOW)


def _bits(found: DataFrame) -> dict[tuple[int, bool], bytes]:
    """For each (width, exact) the filter: which upper FILTER_BITS of a hash occur. At most twice the window's width of them."""
    shift = np.uint64(64 - FILTER_BITS)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            bits: dict[tuple[int, bool], np.ndarray] = {}
            upper = (batch.column(2).to_numpy().view(np.uint64) >> shift).tolist()
            for width, exact, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), upper, strict=True):
                if (width, exact) not in bits:
                    bits[width, exact] = np.zeros(1 << FILTER_BITS, bool)
                bits[width, exact][at] = True
            return pa.record_batch([pa.array([k[0] for k in bits], pa.int32()), pa.array([k[1] for k in bits], pa.bool_()), pa.array([np.packbits(b).tobytes() for b in bits.values()], pa.binary())], ["width", "exact", "bits"])

        return step

    def joined(rows: pa.Table) -> pa.Table:
        every = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
        for b in rows["bits"]:
            every |= np.frombuffer(b.as_buffer(), np.uint8)
        return pa.table({"width": rows["width"][:1], "exact": rows["exact"][:1], "bits": pa.array([every.tobytes()], pa.binary())})

    shape = "width int, exact boolean, bits binary"
    parts = map_batches(found.select("width", "exact", "hash"), make, shape)
    return {(r["width"], r["exact"]): bytes(r["bits"]) for r in parts.groupBy("width", "exact").applyInArrow(joined, shape).collect()}


def document_windows(docs: DataFrame, bits: dict[tuple[int, bool], bytes]) -> DataFrame:
    """(row, doc_id, digest, width, exact, hash, place, codes, words) for the windows of docs that pass the filter."""
    shift = np.uint64(64 - FILTER_BITS)

    def make():
        cache, rows = WordCodes(), TaskContext.get().partitionId() << 32
        filters = {k: np.frombuffer(b, np.uint8) for k, b in bits.items()}

        def look(ids: list, digests: list, texts: list[str], first: int) -> list[tuple]:
            codes, starts = [], []
            for text in texts:
                starts.append(len(codes))
                codes.extend(map(cache.__getitem__, text.split()))
                codes.append(_BREAK)
            raw = np.array(codes, np.uint64)
            kept = np.cumsum(raw != 0)
            ends = np.array([0, *kept[np.array(starts[1:], int) - 1].tolist(), kept[-1]])
            code, value = _template(raw)
            out = []
            for (width, exact), passes in filters.items():
                h = _hashes(code, value, width, exact)
                upper = h >> shift
                at = np.flatnonzero(passes[upper >> np.uint64(3)] & (np.uint8(128) >> (upper & np.uint64(7)).astype(np.uint8)))
                text = np.searchsorted(ends, at, "right") - 1
                inside = at + width < ends[text + 1]  # the last place of a text is its break
                if width < LEAST_WORDS:
                    inside = at + width + 1 == ends[text + 1]
                    inside &= at == ends[text]
                for i, t in zip(at[inside].tolist(), text[inside].tolist(), strict=True):
                    out.append((first + t, ids[t], digests[t], width, exact, int(h[i].view(np.int64)), i - int(ends[t]), code[i : i + width].tobytes(), value[i : i + width].tobytes()))
            return out

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal rows
            ids, digests, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            group: list[str] = []
            start = size = 0
            for i, scalar in enumerate(batch.column(1)):
                group.append(scalar.as_py() or "")
                size += len(group[-1])
                if size >= CHUNK or i == batch.num_rows - 1:
                    out += look(ids[start : i + 1], digests[start : i + 1], group, rows + start)
                    group, start, size = [], i + 1, 0
            rows += batch.num_rows
            kinds = {"row": pa.int64(), "doc_id": pa.int64(), "digest": pa.int64()} | _KINDS
            return pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds.values())], list(kinds))

        return step

    own = key_texts(docs).withColumn("digest", F.xxhash64("text"))
    return map_batches(own, make, "row long, doc_id long, digest long, " + _WINDOW)


def judged(min_words: int) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow over the pairs of windows of one document with items: the items that it contains."""

    def run(rows: pa.Table) -> pa.Table:
        first = {k: rows[k][0].as_py() for k in ("row", "doc_id", "digest")}
        items: dict[tuple, list[dict]] = {}
        for r in rows.drop_columns(["row", "doc_id", "digest"]).to_pylist():
            items.setdefault((r["item_id"], r["item_digest"]), []).append(r)
        out = []
        for (item_id, _), found in sorted(items.items(), key=lambda kv: (kv[0][0] is None, *kv[0])):
            # shift -> place in the item -> (code and word of the item, code and word of the text, whether word for word)
            shifts: dict[int, dict[int, tuple]] = {}
            for r in found:
                arrays = [np.frombuffer(r[k], np.uint64).tolist() for k in ("item_code", "item_value", "codes", "words")]
                same = arrays[1] == arrays[3]
                if not same and r["exact"]:
                    continue
                places = shifts.setdefault(r["place"] - r["item_place"], {})
                for k, (code, word, other, met) in enumerate(zip(*arrays, strict=True)):
                    j = r["item_place"] + k
                    if same or j not in places:
                        places[j] = (code, word, other, met, same or places.get(j, (0,) * 5)[4])
            met, alike, n = set(), True, found[0]["item_words"]
            for places in shifts.values():
                met |= {j for j, p in places.items() if p[4]}
                loose = {j: p for j, p in places.items() if not p[4] and p[0] == p[2]}
                pairs = {(p[1], p[3]) for p in loose.values() if p[0] in _PLACES}
                if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                    met |= set(loose)
                    alike = alike and all(a == b for a, b in pairs)
            if met and len(met) >= min(min_words, n - 1 if n > LEAST_WORDS else n):
                out.append((*first.values(), item_id, len(met), n, alike))
        names = [*first, "item_id", "n_words", "item_words", "alike"]
        return pa.table([pa.array([o[i] for o in out], pa.bool_() if k == "alike" else pa.int64()) for i, k in enumerate(names)], names=names)

    return run


def _found(docs: DataFrame, benchmark: DataFrame, window: int, min_words: int) -> DataFrame:
    """(row, doc_id, digest, item_id, n_words, item_words, alike); see contaminated()."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    with Scratch(docs.sparkSession) as scratch:
        # the id stands for the text as well: an id with several texts is several items
        own = scratch.write(items.withColumn("number", F.xxhash64("item_id", "text")))
        known = item_windows(own.select(F.col("number").alias("item_id"), "text"), window)
        known = known.withColumnsRenamed({"item_id": "item_digest", "place": "item_place", "codes": "item_code", "words": "item_value"})
        known = scratch.write(known.join(own.select(F.col("number").alias("item_digest"), "item_id"), "item_digest"))
        bits = _bits(known)
        met = scratch.write(document_windows(docs, bits))
        side = F.broadcast(known) if known.count() <= BROADCAST_WINDOWS else known
        pairs = met.join(side, ["width", "exact", "hash"])
        shape = "row long, doc_id long, digest long, item_id long, n_words long, item_words long, alike boolean"
        return materialise(pairs.groupBy("row").applyInArrow(judged(min_words), shape))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, item_words, alike) for each item of benchmark (item_id, text) that a text of docs
    (doc_id, text) contains: min_words of its words at least, or all but one of a shorter item's, word for word or with
    consistent slots. alike: the slots' values are the item's own.

    Null and empty texts contain nothing; items of one or two words are found only where they are the whole text; items without words
    never; a null id stays null. Repeated documents give repeated rows, repeated items (same id and text) don't. No rows on either
    side give no rows. Other columns of both sides don't matter.
    """
    return _found(docs, benchmark, window, min_words).drop("row", "digest")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, with all columns, whose text contains no item of benchmark (as contaminated() finds), repeated ones and
    those with null or empty texts or without doc_id as well."""
    own_id, own_digest = fresh(docs, "id_of"), fresh(docs, "digest_of")
    gone = materialise(_found(docs, benchmark, window, min_words).select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest)).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own_digest))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti").select(*(f"`{c}`" for c in docs.columns))
