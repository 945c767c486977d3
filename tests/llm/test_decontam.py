"""Benchmark decontamination against a brute-force matcher and on generated re-parameterised questions."""

import random

from millrace.llm import decontam

MARKS = "\"'()[].,;:!?»«“”’‘-_"


def words_of(text):
    """(template word, word in lower case) of each word; an own rendition without codes or hashes."""
    out, stop, number_before = [], True, False
    for raw in (text or "").split():
        bare = raw
        while bare and not bare[0].isalnum():
            bare = bare[1:]
        while bare and not bare[-1].isalnum():
            bare = bare[:-1]
        if not bare:
            continue
        low = bare.lower()
        digits = low
        for end in ("st", "nd", "rd", "th"):
            digits = digits.removesuffix(end) if digits[:1].isdigit() else digits
        parts, run = [], ""
        for c in digits:
            if c in ".,:/":
                parts.append(run)
                run = ""
            else:
                run += c
        number = all(p.isdecimal() and p for p in [*parts, run])
        title = bare[0].isupper() and (len(bare) == 1 or bare[1:].islower())
        kind = "#" if number else "unit" if low in decontam.UNITS and number_before else "name" if title and not stop else low
        out.append((kind if kind in ("#", "unit", "name") else "=" + low, low))
        number_before = number
        stop = bare != raw and raw.rstrip("\"')]»”’").endswith((".", "!", "?", ":"))
    return out


def brute(text, item, window=decontam.WINDOW, least=decontam.MIN_WORDS):
    """(words met, words of the item, alike), or None."""
    own, other = words_of(item), words_of(text)
    n = len(own)
    width = min(window, n)
    if not n or n < 3 and len(other) != n:
        return None
    met, alike = set(), True
    for shift in range(-n, len(other)):
        exact, loose = set(), set()
        for j in range(n - width + 1):
            if not 0 <= j + shift <= len(other) - width:
                continue
            a, b = own[j : j + width], other[j + shift : j + shift + width]
            plain = sum(x[0][0] == "=" for x in a)
            shaped = 2 * plain >= width and n >= 3
            same = [x[1] for x in a] == [x[1] for x in b]
            if same and (not shaped or j == 0 or [x[0] for x in a] == [x[0] for x in b]):
                exact |= set(range(j, j + width))
            elif shaped and [x[0] for x in a] == [x[0] for x in b]:
                loose |= set(range(j, j + width))
        met |= exact
        loose = {j for j in loose - exact if own[j][0] == other[j + shift][0]}
        pairs = {(own[j][1], other[j + shift][1]) for j in loose if own[j][0][0] != "="}
        if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
            met |= loose
            alike = alike and all(a == b for a, b in pairs)
    return (len(met), n, alike) if met and len(met) >= min(least, n - 1 if n > 3 else n) else None


NAMES = "Anna Boris Clara David Emma Felix Greta Henry Irene Jonas Boston Denver Paris Madrid Oslo".split()
UNITS = "km miles hours minutes kg liters dollars".split()
PLAIN = "the a train left old station and met his friend who had bought many red apples for their long trip before they went home with all of it how far did she travel that day".split()


def question(r, slots):
    """Parts of a question: plain words, and numbers of the slots (kind, number) in between."""
    out = []
    for _ in range(r.randint(3, 6)):
        out += [r.choice(PLAIN) for _ in range(r.randint(4, 7))]
        kind = r.choice(["number", "name", "unit"])
        out.append((kind, r.randrange(slots)))
    return out + [r.choice(PLAIN) for _ in range(5)]


def written(parts, values):
    return " ".join(p if isinstance(p, str) else values[p] for p in parts) + "?"


def values(r, slots):
    names, numbers = r.sample(NAMES, slots), r.sample(range(2, 999), 2 * slots)
    return {("name", i): names[i] for i in range(slots)} | {("number", i): str(numbers[i]) for i in range(slots)} | {("unit", i): f"{numbers[slots + i]} {UNITS[i]}" for i in range(slots)}


def cases():
    r = random.Random(12)
    items, docs = [], []
    for k in range(40):
        parts = question(r, 4)
        items.append((k, written(parts, values(r, 4))))
        docs.append((k, " ".join(r.choice(PLAIN) for _ in range(20)) + ". " + written(parts, values(r, 4)) + " " + " ".join(r.choice(PLAIN) for _ in range(9))))
        wrong = values(r, 4)
        docs.append((1000 + k, written(parts, wrong | {("name", i): "Zoe" for i in range(4)} | {("number", i): "7" for i in range(4)})))  # different values become one
        docs.append((2000 + k, " ".join(r.choice(PLAIN) for _ in range(60))))
        cut = items[-1][1].split()
        docs.append((3000 + k, "It says: " + " ".join(cut[: r.randint(3, len(cut))])))
    items += [(100, "short one"), (101, "Yes"), (102, "three short words"), (103, None), (104, ""), (105, "12 15 18 21 24 27 30 33 36 39 42 45 48 51"), (100, "short one"), (100, "another text of the same id with enough words to count as one of them for sure")]
    docs += [(5000, "short one"), (5001, "a short one here"), (5002, "Yes."), (5003, "these are three short words again"), (5004, None), (5005, ""), (5006, "see 12 15 18 21 24 27 30 33 36 39 42 45 48 51 there"), (None, "Yes"), (5000, "short one"), (5007, "another text of the same id with enough words to count as one of them for sure")]
    return items, docs


def test_same_as_brute_force(spark):
    items, docs = cases()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "TEXT")
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, hash string, row int").repartition(3)
    got = sorted((tuple(r) for r in decontam.contaminated(frame, bench).collect()), key=str)
    want = sorted(((d, i, *m) for d, text in docs for i, item in sorted(set(items), key=str) if (m := brute(text, item))), key=str)
    assert got == want
    caught = {(d, i) for d, i, *_ in got}
    assert sum((k, k) in caught for k in range(40)) >= 36  # other numbers, names and units
    assert not any(d is not None and 2000 <= d < 3000 for d, _ in caught)
    gone = {(d, t) for d, t in docs if any(brute(t, i) for _, i in set(items))}
    kept = decontam.keep_clean(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted((x for x in docs if x not in gone), key=str)


def test_a_large_benchmark_is_shuffled(spark, monkeypatch):
    items, docs = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(str, decontam.contaminated(frame, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontam, "FILTER_BITS", 8)
    assert sorted(map(str, decontam.contaminated(frame, bench).collect())) == want
    assert decontam.contaminated(frame.limit(0), bench).count() == decontam.contaminated(frame, bench.limit(0)).count() == 0
    assert decontam.keep_clean(frame, bench.limit(0)).count() == len(docs)
