"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Texts are hashed byte n-gram profiles. A linear SVM for each family (one against the rest) chooses the family; within
it a linear SVM for each pair of languages votes. Margins become probabilities by a logistic curve that is fitted to
the training margins; the score of a prediction is the product of the two steps' probabilities.

The SVMs are fitted to a bounded sample of labelled rows (PER_LANGUAGE texts a language, TOTAL_ROWS in all, chosen by hash), so the
model costs the same at any size; prediction reads every whole text.
"""

from __future__ import annotations

import itertools
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, fresh, give_back, key_texts, map_batches

#: Training rows a language at most, and size of a profile.
PER_LANGUAGE, DIM = 300, 1 << 13
#: The training rows of a language are chosen from the rows whose ids have the least hashes, about so many times PER_LANGUAGE.
POOL = 4
#: Training rows at most: with many languages each gives fewer, and one at least as long as there are no more languages than this.
TOTAL_ROWS = 30_000
#: From so many letters on a text that is less than FLOOR times as near to its predicted language (cosine of its profile and the mean of
#: the language's) as the farthest training text of so many letters is in none of the learned languages.
FLOOR_LETTERS, FLOOR = 10, 0.6
#: Families of ISO 639-1 codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn mr ne gu pa ur as or",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "semitic": "ar he am mt",
}
_LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes.split()), lang)


def profile(text: str) -> np.ndarray:
    """Square roots of hashed counts of 1- to 4-grams of the lower-cased text's bytes, as a unit vector."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    # digits and ASCII marks say nothing of the language, whatever their number
    b = np.where((b < 97) | (b > 122) & (b < 128), np.uint8(32), b)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])] if len(b) else b
    code, counts = b.astype(np.uint32), np.zeros(DIM)
    for n in range(1, 5):
        if n > 1:
            code = code[:-1] * np.uint32(257) + b[n - 1 :].astype(np.uint32)
        if len(code):
            slot = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - DIM.bit_length() + 1)
            counts += np.bincount(slot, minlength=DIM)
    counts = np.sqrt(counts)
    norm = np.linalg.norm(counts)
    return (counts / norm if norm else counts).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, c: float = 20.0) -> np.ndarray:
    """A linear SVM with squared hinge loss for y of -1 and 1, by accelerated gradient steps; the last weight is the
    bias. Both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = look = np.zeros(x.shape[1], np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step, t = 1 / (1 + 4 * c), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ look))
        new = look - step * (look - 2 * c * (x.T @ (share * slack * y)))
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + (t - 1) / ahead * (new - w), new, ahead
    return w


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    family: np.ndarray  # a row of weights for each family
    pairs: list[tuple[str, str, np.ndarray]]  # positive margins speak for the first
    means: np.ndarray | None = None  # the mean profile of each language, as a unit vector
    floor: float = 0.0  # the least nearness of a text that is in its predicted language

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        return self.decide(profile(text))

    def near(self, own: np.ndarray, lang: str) -> float:
        """How near a profile is to a language, 0 to 1."""
        return 1.0 if self.means is None else float(self.means[self.languages.index(lang)] @ own)

    def decide(self, own: np.ndarray) -> tuple[str, float]:
        """The language of a profile, and how sure it is."""
        x = np.append(own, np.float32(1))
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            p = 1 / (1 + np.exp(-3 * (self.family @ x).astype(float)))
            best = int(p.argmax())
            family, sure = self.families[best], float(p[best])
        inside = [lang for lang in self.languages if family_of(lang) == family]
        votes, chance = dict.fromkeys(inside, 0), dict.fromkeys(inside, 1.0)
        for a, b, w in self.pairs:
            if a in votes and b in votes:
                p = float(1 / (1 + np.exp(-3 * float(w @ x))))
                votes[a if p >= 0.5 else b] += 1
                chance[a] *= p
                chance[b] *= 1 - p
        # the most votes win; equal votes go to the likelier language
        lang = max(inside, key=lambda k: (votes[k], chance[k], k))
        return lang, min(1.0, max(0.0, sure * chance[lang]))


def held_out(key):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def many_letters(text: str) -> bool:
    return sum(1 for _ in itertools.islice(_LETTER.finditer(text), FLOOR_LETTERS)) == FLOOR_LETTERS


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit to rows of docs (doc_id, text, lang) that have a lang, an id and letters and aren't held out. Rows that repeat an id and a
    language count once; with no such row, or none at all, nothing is learned and all predictions are und. Other columns don't matter."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).filter(r"text RLIKE '\\p{L}'")
    rows = usable.select("doc_id", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(TOTAL_ROWS).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], [], np.zeros((0, DIM + 1)), [])
    per_language = max(1, min(per_language, TOTAL_ROWS // len(languages)))
    # ids only, and of these the ones with the least hashes: some POOL times per_language a language, however many rows there are
    least = docs.sparkSession.createDataFrame([(k, min(2**63 - 1, int(2**64 * POOL * per_language / n) - 2**63)) for k, n in counts.items()], "lang string, most long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.join(F.broadcast(least), "lang").filter(F.xxhash64("doc_id") <= F.col("most")).withColumn("rank", rank).filter(F.col("rank") <= per_language).select("doc_id", "lang", "rank")
    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "rank", "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(a, r, t) for a, r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t and _LETTER.search(t)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32()), pa.array([profile(f[2]).astype(np.float16).tobytes() for f in found], pa.binary()), pa.array([many_letters(f[2]) for f in found], pa.bool_())]
            return pa.record_batch(columns, ["lang", "rank", "x", "many"])

        return step

    sample = map_batches(texts, make, "lang string, rank int, x binary, many boolean").dropDuplicates(["lang", "rank"]).collect()  # rows may repeat an id
    sample.sort(key=lambda r: (r["lang"], r["rank"], bytes(r["x"])))  # the order decides the last bits of the weights
    x = np.array([np.frombuffer(r["x"], np.float16) for r in sample], np.float32).reshape(-1, DIM)
    y = np.array([r["lang"] for r in sample], dtype=object)
    languages = [k for k in languages if (y == k).any()]
    families = sorted({family_of(k) for k in languages})
    own = np.array([family_of(k) for k in y], dtype=object)
    family = np.array([fit_svm(x, np.where(own == f, 1, -1).astype(np.float32)) for f in families] if len(families) > 1 else np.zeros((0, DIM + 1)))
    pairs = []
    for i, a in enumerate(languages):
        for b in languages[i + 1 :]:
            if family_of(a) == family_of(b):
                mine = (y == a) | (y == b)
                pairs.append((a, b, fit_svm(x[mine], np.where(y[mine] == a, 1, -1).astype(np.float32))))
    means = np.array([x[y == k].mean(axis=0) for k in languages])
    model = Model(languages, families, family, pairs, means / np.linalg.norm(means, axis=1, keepdims=True))
    model.floor = FLOOR * min((model.near(v, model.decide(v)[0]) for v, r in zip(x, sample, strict=True) if r["many"]), default=0.0)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text), from the text alone.

    und and score 0 where the text is null or has no letter, or nothing was learned. Repeated rows give repeated results,
    no rows none.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            return pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

        return step

    return map_batches(key_texts(docs), make, "doc_id long, lang_pred string, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, languages: Collection[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """The rows of docs, with all columns, whose text is in one of the languages (all learned ones by default).

    Texts of no language go: null, empty or without letters, and those of FLOOR_LETTERS letters or more that are less near to the
    language predicted for them than the model's floor (other scripts, random letters) or whose score is less than min_score. So do
    texts in other languages than the given ones. Where nothing was learned, all texts with letters stay. Repeated rows stay or go together; no rows give none; columns may have any names.
    """

    bound_batches(docs.sparkSession)
    wanted = None if languages is None else frozenset(languages)

    @F.arrow_udf("boolean")
    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_passes(model, wanted, min_score, t.as_py()) for t in texts], pa.bool_())
        give_back()

    kept = fresh(docs, "kept")
    return docs.withColumn(kept, passes(F.col("text").cast("string"))).filter(F.col(kept)).drop(kept)


def _passes(model: Model, languages: frozenset[str] | None, least: float, text: str | None) -> bool:
    if not text or not _LETTER.search(text):
        return False
    if not model.languages:
        return True
    own = profile(text)
    lang, score = model.decide(own)
    return (languages is None or lang in languages) and (not many_letters(text) or score >= least and model.near(own, lang) >= model.floor)
