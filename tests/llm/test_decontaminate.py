import itertools
import random
import re

from llm_helpers import DOCUMENTS, awkward_rows

from harvestline.llm.decontaminate import SHARE, SHORTEST, SPAN, STRETCH, decontaminate, find_leaks

BENCHMARK = "item_id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows, items):
    """Pairs in which some diagonal has a stretch that agrees enough."""
    found = set()
    for doc_id, text, *_ in rows:
        d = words(text)
        for item_id, item in items:
            w = words(item)
            if len(w) < SHORTEST:
                continue
            wide, least = min(len(w), STRETCH), 1.0 if len(w) < SPAN else SHARE
            for at in range(-len(w) + 1, len(d)):
                agree = [0 <= at + i < len(d) and d[at + i] == w[i] for i in range(len(w))]
                if max(sum(agree[j : j + wide]) for j in range(len(w) - wide + 1)) >= least * wide:
                    found.add((doc_id, item_id))
                    break
    return found


def planted(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((3, 5, 6, 7, 8, 12, 30, 60))))) for i in range(25)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(0, 80))]
        if i % 2:
            piece = rng.choice(items)[1].split()
            for _ in range(rng.choice((0, 1, 2, 3))):
                piece[rng.randrange(len(piece))] = "changed"
            cut = rng.choice((0, 0, 4))
            text[len(text) // 2 : len(text) // 2] = piece[cut:]
        rows.append((i, ", ".join(text), "en", "a", 1))
    return rows, items


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_leaks_as_brute_force_finds_them(spark):
    for seed in (1, 2):
        rows, items = planted(seed)
        docs, bench = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(items, BENCHMARK)
        want = brute(rows, items)
        got = pairs(find_leaks(docs, bench))
        assert got <= want
        # Seeds need five of eight words; a passage with more changed may escape them.
        assert len(want - got) <= 0.05 * len(want)
        assert pairs(find_leaks(docs, bench, broadcast_seeds=0)) == got


def test_changed_words_are_tolerated_and_counted(spark):
    item = " ".join(f"t{i}" for i in range(20))
    changed = item.replace("t9 ", "zz ").replace("t3 ", "yy ")
    docs = spark.createDataFrame([(1, f"before {changed} after", "en", "a", 1), (2, "before after", "en", "a", 1)], DOCUMENTS)
    (leak,) = find_leaks(docs, spark.createDataFrame([(5, item)], BENCHMARK)).collect()
    assert (leak["doc_id"], leak["item_id"], leak["first_word"], leak["n_agree"], leak["n_compared"]) == (1, 5, 1, 15, 16)


def test_awkward_rows(spark):
    rows = awkward_rows()
    items = [(1, rows[0][1]), (1, rows[0][1]), (2, None), (3, ""), (None, "springt über den faulen Hund"), (4, "one two")]
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS item", "2 AS words", "3 AS seed", "4 AS _leak")
    bench = spark.createDataFrame(items, BENCHMARK).selectExpr("*", "1 AS doc_id", "2 AS at")
    assert pairs(find_leaks(docs, bench)) == brute(rows, [i for i in items if i[1]])
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 4, 5, 6, 8, 9, 10, 11]


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], BENCHMARK)
    docs, items = spark.createDataFrame(awkward_rows(), DOCUMENTS), spark.createDataFrame([(1, "a b c d e f")], BENCHMARK)
    assert find_leaks(no_docs, items).collect() == []
    assert find_leaks(docs, no_items).collect() == []
    assert decontaminate(docs, no_items).count() == docs.count()


def test_every_allowed_change_of_a_passage_is_found(spark):
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in range(SPAN, STRETCH + 2)]
    rows = []
    for n, item in items:
        wide = min(n, STRETCH)
        lost = max(k for k in range(wide) if wide - k >= SHARE * wide)
        for gone in itertools.combinations(range(n), lost):
            text = ["zz" if j in gone else w for j, w in enumerate(item.split())]
            rows.append((len(rows), " ".join(text), "en", "a", 1))
            # The same with the changed words at the ends left out.
            if {0, n - 1} & set(gone):
                rows.append((len(rows), " ".join(text).strip("z "), "en", "a", 1))
    docs, bench = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(items, BENCHMARK)
    want = {(r[0], int(re.search(r"i(\d+)x", r[1])[1])) for r in rows}
    assert brute(rows[:40], items) == {p for p in want if p[0] < 40}
    assert pairs(find_leaks(docs, bench)) == want == pairs(find_leaks(docs, bench, broadcast_seeds=0))


def test_leaks_are_exactly_those_of_brute_force(spark):
    for seed in (1, 3):
        rows, items = planted(seed)
        docs, bench = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(items, BENCHMARK)
        assert pairs(find_leaks(docs, bench)) == brute(rows, items)


def test_items_of_few_words_are_found_where_they_are_the_text(spark):
    items = [(1, "Paris"), (2, "one two"), (3, "a b c d"), (4, ""), (5, " ".join(f"t{i}" for i in range(20)))]
    texts = ["paris!", "Paris Paris", "One, two.", "one two three", "two one", "A b c d", "a b c", "", None]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCUMENTS)
    bench = spark.createDataFrame(items, BENCHMARK)
    for most in (1_000_000, 0):
        assert pairs(find_leaks(docs, bench, broadcast_seeds=most)) == {(0, 1), (2, 2), (5, 3)}


def test_a_very_long_item(spark):
    rng = random.Random(6)
    words_ = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    item = " ".join(words_)
    changed = " ".join("zz" if i % 9 == 0 else w for i, w in enumerate(words_))
    texts = [item] * 40 + [changed] * 40 + ["intro " + " ".join(words_[500 + i : 530 + i]) for i in range(20)]
    texts += [" ".join(rng.choice(words_) for _ in range(2000)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCUMENTS)
    for most in (1_000_000, 0):
        found = {r["doc_id"]: r for r in find_leaks(docs, spark.createDataFrame([(7, item)], BENCHMARK), most).collect()}
        assert sorted(found) == list(range(100))
        assert {(r["first_word"], r["n_agree"]) for i, r in found.items() if i < 40} == {(0, 16)}
        assert all(found[80 + i]["first_word"] == 1 - (500 + i) for i in range(20))
