import random
import re
from collections import Counter

from cloakline.llm import decontamination as D
from cloakline.llm.common import Lexicon


def bags(words, n):
    n = min(n, len(words))
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def brute(docs, items, least=0.8, shingle=5):
    out = {}
    for d, text in docs:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for i, item in items:
            w = re.findall(r"[^\W_]+", (item or "").lower())
            if not w or not words:
                continue
            k, size = min(shingle, len(w)), min(len(w), len(words))
            want = bags(w, k)
            best = max(D.similarity(bags(words[s : s + size], k), want) for s in range(len(words) - size + 1))
            if best >= least - 1e-12:
                out[d, i] = round(best, 9)
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnprst")
    items = [(k, " ".join(word() for _ in range(rng.choice((3, 12, 25, 40))))) for k in range(12)] + [(12, None), (13, ""), (14, "one"), (15, "Same words, same words! Same words; same words.")]
    docs = []
    for d in range(60):
        words = [word() for _ in range(rng.choice((0, 5, 60, 200)))]
        if d % 3 == 0:
            part = items[d % 12][1].split()
            if d % 2:
                part[0 if d % 4 else -1] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "ONE"), (103, "x same words, same words; same words... same words y"), (104, items[3][1].upper() + "!!")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    rows = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == brute(docs, items)
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows}) > 15


def test_groups_of_items_give_the_same(spark):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.item_id, r.start_word, r.similarity) for r in rows)
    assert key(D.leaks(d, i).collect()) == key(D.leaks(d, i, group_items=5).collect())
    clean = {r.doc_id for r in D.decontaminate(d, i).collect()}
    assert clean == {x for x, _ in docs} - {x for x, _ in brute(docs, items)}
    assert clean == {r.doc_id for r in D.decontaminate(d, i, group_items=5).collect()}


def test_index_finds_all_within_the_radius():
    index = D.ItemIndex([(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(40)])
    rng = random.Random(2)
    for item in index.items:
        own = next(iter(index.index.values()))
        for far in (0, 5, 15, index.radius):
            fp = int(item.print)
            for b in rng.sample(range(64), far):
                fp ^= 1 << b
            assert index.items.index(item) in {x for block in range(index.blocks) for x in own.get((block, index.value(fp, block)), ())}


def test_edge_rows(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(documents, none).count() == 0
    same = D.decontaminate(documents, none)
    assert same.columns == documents.columns and same.count() == documents.count()
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank"), (1, "The quick brown fox jumps over the lazy dog near the river bank")], "item_id long, text string")
    got = D.leaks(documents, items).collect()
    assert sorted(r.doc_id for r in got) == [0, 0, 3, 3, 4, 4, 4, 4]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in D.decontaminate(documents, items).collect()) == [(False, 1), (False, 2), (False, 5), (False, 6), (False, 7), (True, 0)]
    assert D.decontaminate(documents.limit(0), items).count() == 0


def test_lexicon_takes_texts():
    lexicon = Lexicon()
    assert lexicon.ids(["a", "b", "a"]).tolist() == [0, 1, 0] and len(lexicon.array()) == 2
