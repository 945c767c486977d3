"""What the first round's review found missing in the corpus operators."""

import random
import string

import corpus_pipeline
from millrace.llm import decontam, langid, secrets
from tests.conftest import DATA
from tests.llm.test_operators import brute_components


def hits(spark, items, text):
    """{place of an item: (words met, words of the item, alike)} for one text."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = decontam.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).collect()
    return {r["item_id"]: (r["n_words"], r["item_words"], r["alike"]) for r in found}


def test_near_copies_are_those_by_five_words(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join("x" if i in (20, 70, 120, 170) else w for i, w in enumerate(words))), (3, "some other text of its own")]
    rows += [(10 + i, " ".join("y" if j % 25 == 7 and j < 25 * i else w for j, w in enumerate(words[::-1]))) for i in range(9)]
    got = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()}
    assert got == {i for i, _, c in brute_components(rows, 5, 80) if i == c} and 2 not in got


def test_a_changed_value_hides_no_verbatim_passage(spark):
    item = "A train leaves the old station at 40 km from Boston and travels with Maria for 3 hours until it meets a bus at 40 km again"
    assert hits(spark, [item], f"Before it. {item} And after.") == {0: (len(item.split()), len(item.split()), True)}
    assert hits(spark, [item], item.replace("40", "55", 1))[0][2] is False
    both = item.replace("40", "55", 1).replace(" 3 ", " 55 ")  # two values become one, 13 words stay as they are
    assert 0 in hits(spark, [item + " and then waits there for the next one to come"], both + " and then waits there for the next one to come")
    shape = "A train leaves the old station at 55 km from Rome and travels with Rome for 55 hours until it meets a bus at 7 km again"
    assert hits(spark, [item], shape) == {}


def test_verbatim_items_of_numbers_and_names_are_found(spark):
    names = "George Washington John Adams Thomas Jefferson James Madison James Monroe Andrew Jackson Martin Van Buren Zachary Taylor Millard Fillmore Franklin Pierce"
    items = [names, "12 + 15 = 27 and 18 + 21 = 39 30", "Compute the sum of 12, 15, 18, 21, 24, 27, 30, 33, 36, 39, 42, 45", "Where did Ada Lovelace meet Charles Babbage"]
    for k, item in enumerate(items):
        met, words, alike = hits(spark, items, f"as it was asked then {item} and so on")[k]
        assert met == words and alike
    assert hits(spark, items, "as it was asked then " + names.replace("John", "Paul").replace("James", "Peter").replace("Martin", "Mark") + " and so on") == {}


def test_long_secrets_are_whole(spark):
    r = random.Random(6)
    long = {n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (201, 5000)}
    late = "".join(r.choice(string.ascii_letters) for _ in range(80)) + long[201]
    texts = [t for v in long.values() for t in (f'x token = "{v}" y', f"key AKIA{v} end", f"secret {v} end")] + [f"secret {late} end"]
    values = [x for v in long.values() for x in (v, f"AKIA{v}", v)] + [late]
    found = secrets.candidates(spark.createDataFrame([(i, t, "src/a") for i, t in enumerate(texts)], "doc_id long, txt string, path string")).collect()
    assert {x["doc_id"]: x["v"] for x in found} == dict(enumerate(values)) and len(found) == len(texts)
    assert all(texts[x["doc_id"]][x["s"] : x["e"]] == x["t"] for x in found)
    got = secrets.scan(spark.createDataFrame([(i, t, "src/a") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    assert all(x["value_sha256"] == secrets.value_hash(values[x["doc_id"]]) for x in got) and {x["doc_id"] for x in got} == set(range(len(texts)))


def test_texts_stay_where_no_language_was_learned(spark):
    rows = spark.createDataFrame([(1, "a text", None), (2, "12 !?", None), (3, None, None), (4, "ü", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, rows, DATA).collect()} == {1, 4}
