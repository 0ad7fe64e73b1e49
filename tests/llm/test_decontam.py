import hashlib
import random
import re

from helpers import AWKWARD, docs, rows

from molmill.llm.decontam import contamination, drop_contaminated

NAMES = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(given, items):
    out = []
    for doc_id, text in given:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(13, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        ids.add(item if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(i for i in ids if i is not None)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def made(seed, n_docs, n_items, vocabulary):
    r = random.Random(seed)
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, some(r.choice([1, 2, 4, 5, 6, 12, 13, 14, 20, 40]) + (i % 3 > 0) * 13)) for i in range(n_items)]
    items += [(100, items[1][1]), (101, items[2][1][:15] + some(9))]
    given = []
    for i in range(n_docs):
        text = some(r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            v = r.choice(items)[1]
            a = r.randrange(max(1, len(v) - 12))
            text += v[a : a + r.randrange(11, 30)] + some(r.randrange(5))
        given.append((i, (", " if i % 2 else " ").join(text).title() if i % 3 else " ".join(text)))
    return given, [(i, "-".join(v)) for i, v in items]


def test_agrees_with_brute_force(spark):
    many, few = [f"w{i}" for i in range(500)], ["é", "b", "C1"]
    for seed, vocabulary in ((1, many), (2, few)):
        given, items = made(seed, 60, 12, vocabulary)
        given, items = given + AWKWARD, items + [(7, None), (8, ""), (9, "..."), (2, items[2][1]), (None, items[3][1]), (None, items[4][1] + " " + items[5][1])]
        if vocabulary is many:
            items += [(200, "One"), (201, "a b c")]
        table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as gram", "2 as doc_id")
        assert rows(contamination(docs(spark, given), table), *NAMES) == plain(given, items)


def test_a_large_group_of_documents_and_items_with_one_passage(spark):
    shared = " ".join(f"p{i}" for i in range(30))
    given = [(i, f"x{i} y{i} {shared} z{i}") for i in range(300)] + [(1000, "clean text")]
    items = [(i, f"{shared} q{i}") for i in range(40)]
    d, t = docs(spark, given), spark.createDataFrame(items, "item_id long, text string")
    assert rows(contamination(d, t), *NAMES) == plain(given, items)
    assert rows(drop_contaminated(d, t), "doc_id") == [(1000,)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs(spark, []), none).count() == 0
    got = contamination(docs(spark, AWKWARD), none)
    assert rows(got, *NAMES) == plain(AWKWARD, [])
    assert drop_contaminated(docs(spark, AWKWARD), none).count() == len(AWKWARD)
