import random
import re

import xxhash
from helpers import AWKWARD, docs, rows

from molmill.llm.components import components
from molmill.llm.simhash import drop_near_copies, near_links, simhash_documents


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_classes(given):
    prints = [plain_fingerprint(t) for _, t in given]
    at = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and at[i] != at[j]:
                old, new = at[i], at[j]
                at = [new if x == old else x for x in at]
    least = {c: min((given[i][0] for i in range(len(given)) if at[i] == c and given[i][0] is not None), default=None) for c in at}
    return sorted(((given[i][0], f"{prints[i]:016x}", least[at[i]]) for i in range(len(given))), key=repr)


def texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            old = r.choice(out)[1].split()
            for _ in range(r.randrange(3)):
                old[r.randrange(len(old))] = r.choice(words)
            out.append((i, " ".join(old)))
        else:
            out.append((i, " ".join(r.choice(words) for _ in range(r.randrange(1, 120)))))
    return out


def test_awkward_and_random_rows_agree_with_brute_force(spark):
    given = AWKWARD + [(100 + i, t) for i, t in texts(300, 1)]
    assert rows(simhash_documents(docs(spark, given)), "doc_id", "fingerprint", "component_id") == plain_classes(given)


def test_empty_and_extra_columns(spark):
    none = docs(spark, [])
    assert simhash_documents(none).count() == 0 and drop_near_copies(none).count() == 0
    more = docs(spark, [(1, "a b"), (2, "a b")]).selectExpr("*", "1 as fp", "'x' as component_id", "2 as cell", "3 as u")
    assert rows(simhash_documents(more), "doc_id", "component_id") == [(1, 1), (2, 1)]
    assert drop_near_copies(more).columns == more.columns


def test_one_row_of_each_group_stays(spark):
    given = AWKWARD + [(200 + i, t) for i, t in texts(200, 2)] + [(200, texts(200, 2)[0][1])]
    got = rows(drop_near_copies(docs(spark, given)), "doc_id")
    want = {c for _, _, c in plain_classes(given)}
    assert sorted(x for (x,) in got if x is not None) == sorted(x for x in want if x is not None)


def test_cells_of_several_tiles(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(25)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    at = {x: x for x in signed}
    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 3 and at[signed[i]] != at[signed[j]]:
                old, new = sorted((at[signed[i]], at[signed[j]]), reverse=True)
                at = {k: new if v == old else v for k, v in at.items()}
    linked = {k: v for k, v in at.items() if sum(w == v for w in at.values()) > 1}
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for tile in (3, 4096):
        assert {x.node: x.component for x in components(near_links(table, tile=tile)).collect()} == linked
