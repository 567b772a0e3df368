import random

from conftest import rows
from replicata.llm.leakage import leaked_items, tables_for, words


def test_words():
    assert words("Ca-\nrrier, the Vi\u00adal\u200b! 7_x") == ["carrier", "the", "vial", "7", "x"]
    assert words("well-known end-\r\n  > ing") == ["well", "known", "ending"]
    assert words(None) == words("") == []


def test_passages_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 30])))) for i in range(40)] + [(99, None)]
    docs = []
    for i in range(120):
        t = [rng.choice([*vocab, f"o{rng.randrange(99)}"]) for _ in range(60)]
        if i % 2:
            w = words(rng.choice(items[:40])[1])
            n = min(len(w), rng.choice([11, 12, 20]))
            k = rng.randrange(len(w) - n + 1)
            t[20:20] = w[k : k + n]
        docs.append((i, ",  ".join(t).upper()))
    docs += [(500, None), (501, ""), (502, docs[1][1])]
    want = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for i, x in items:
            v = words(x)
            if any(tuple(v[k : k + 12]) in grams for k in range(len(v) - 11)):
                want.add((d, i))
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    exact = lambda **more: rows(leaked_items(d, q, **more).filter("edits = 0").select("doc_id", "item_id"))
    assert exact(edits=0) == exact() == exact(edits=2) == sorted(want)
    # more items than one block are matched by a join
    assert exact(edits=0, block_windows=50) == exact(block_windows=50) == sorted(want)
    assert leaked_items(d.limit(0), q).count() == 0 and leaked_items(d, q.limit(0)).count() == 0
    assert leaked_items(d.limit(0), q, block_windows=0).count() == 0


def _least(item, text, most):
    """Fewest edits between 12 consecutive words of an item and any stretch of a text, by dynamic programming over all stretches."""
    best = most + 1
    for k in range(len(item) - 11):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item[k : k + 12], 1):
            last, row[0] = row[0], i
            for j, y in enumerate(text, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        best = min(best, *row)
    return best


def test_recall_with_edits(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(200)]
    word = lambda: rng.choice(vocab)
    items = [(i, [word() for _ in range(12 + i % 2 * 3)]) for i in range(120)]
    docs = []
    for e in (1, 2):
        for kind in ("substituted", "inserted", "deleted"):
            for i, w in items:
                t = list(w)
                for p in sorted(rng.sample(range(1, len(w) - 1), e), reverse=True):
                    t[p : p + (kind != "inserted")] = [] if kind == "deleted" else [word()]
                docs.append((len(docs), e, kind, i, [word() for _ in range(rng.randrange(9))] + t + [word() for _ in range(rng.randrange(9))]))
    truth = {d: _least(items[i][1], t, 2) for d, _, _, i, t in docs}
    df = spark.createDataFrame([(d, " ".join(t)) for d, *_, t in docs], "doc_id bigint, text string")
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    for most in (1, 2):
        for block in (500_000, 10):
            found = {(r.doc_id, r.item_id): r.edits for r in leaked_items(df, q, edits=most, block_windows=block).collect()}
            for e in range(1, most + 1):
                for kind in ("substituted", "inserted", "deleted"):
                    true = [(d, i) for d, n, k, i, _ in docs if (n, k) == (e, kind) and truth[d] <= most]
                    hit = [p for p in true if p in found]
                    assert len(true) > 60 and len(hit) >= 0.9 * len(true), (most, e, kind, len(hit), len(true))
            # nothing is found that is not there, and never with fewer edits
            assert all(e >= truth[d] for (d, i), e in found.items() if docs[d][3] == i)
            assert all(_least(items[i][1], docs[d][4], most) <= e for (d, i), e in list(found.items())[:200])


def test_tables_follow_from_the_recall():
    assert tables_for(12, 0, 0.95, 4) == 1
    assert tables_for(12, 1, 0.8, 4) <= tables_for(12, 1, 0.95, 4) <= tables_for(12, 2, 0.95, 4)
