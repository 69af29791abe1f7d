import zlib

import numpy as np
import pyarrow.parquet as pq
from llm_helpers import DOCUMENTS, SF_DIR, awkward_rows

from harvestline.llm import language_id as li


def test_held_out_accuracy_and_what_is_held_out(spark):
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = li.language_report(docs).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.98 * len(out)


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    lied = docs.withColumn("lang", li.F.when(li.held_out(docs["doc_id"]), "xx").otherwise(docs["lang"]))
    a, b = (sorted(map(tuple, li.language_report(d).collect())) for d in (docs, lied))
    assert a == b


def test_family_then_pairs():
    rng = np.random.default_rng(1)
    letters = {"de": "abcd", "nl": "abce", "fr": "pqrs", "it": "pqrt"}
    texts, langs = [], []
    for lang, own in letters.items():
        for _ in range(60):
            texts.append(" ".join("".join(rng.choice(list(own), 4)) for _ in range(30)))
            langs.append(lang)
    model = li.fit(np.stack([li.features(t) for t in texts]), langs)
    assert model.families == ["germanic", "romance"]
    assert model.langs == [["de", "nl"], ["fr", "it"]]
    assert [list(p) for p in model.pairs] == [[(0, 1)], [(0, 1)]]
    found, score = li.predict(model, np.stack([li.features(t) for t in texts]))
    assert sum(a == b for a, b in zip(found, langs, strict=True)) >= 0.98 * len(langs)
    assert ((score >= 0) & (score <= 1)).all()


def test_features_do_not_depend_on_the_cut(monkeypatch):
    text = "Ein schöner Tag, 12 Öfen und der Fuß. " * 20
    whole = li.features(text)
    monkeypatch.setattr(li, "_PIECE", 37)
    assert np.allclose(li.features(text), whole)


def test_awkward_rows_and_clashing_columns(spark):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS lang_pred", "2 AS score", "3 AS doc", "4 AS k")
    got = li.language_report(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == sorted((r[0] or 0) for r in rows)
    nothing = {3, 4, 5, 6}
    for r in got:
        if r["doc_id"] in nothing:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in {"en", "de", "fr"}
        else:
            assert not r["held_out"]
    kept = li.keep_identified(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in rows if li.has_letter(r[1]))


def test_signs_that_are_no_letters(spark):
    texts = ["½ ² ①", "⅓ ㊿ Ⅷ ٣ _", "٣٤", "12 ª", "é", "_x_", "日"]
    assert [li.has_letter(t) for t in texts] == [False] * 3 + [True] * 4
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(10**6 + i, t, None, "odd", 1) for i, t in enumerate(texts)], DOCUMENTS)
    got = {r["doc_id"]: r for r in li.language_report(docs.unionByName(more)).collect() if r["doc_id"] >= 10**6}
    assert [(got[10**6 + i]["lang_pred"], got[10**6 + i]["score"]) for i in range(3)] == [("und", 0.0)] * 3
    assert all(got[10**6 + i]["lang_pred"] != "und" for i in range(3, 7))


def test_one_id_for_everything_is_still_a_bounded_sample(spark):
    free = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.range(20_000).selectExpr(
        f"{free}L AS doc_id", "concat('the same words and number ', if(id % 4 = 0, 0, id)) AS text", "if(id % 2 = 0, 'en', 'de') AS lang"
    )
    rows = li._sample_of(docs, 400).collect()
    assert 200 <= len(rows) <= 400 and {r["lang"] for r in rows} == {"en", "de"}


def test_nothing_to_learn_from_and_empty_table(spark):
    rows = [(1, "some words", None, "a", 1), (2, None, None, "a", 1)]
    got = li.language_report(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert li.language_report(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_nothing_learned_keeps_what_has_a_letter(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 1]
    for rows in (
        [(1, "some words", None, "a", 1), (2, None, None, "a", 1), (3, "12 !", None, "a", 1), (4, "Ж", None, None, 1)],
        [(i, f"clean words {i}", "en", "a", 1) for i in held] + [(41, "", "en", "a", 1)],
        [(i, f"one language {i}", "en", "a", 1) for i in range(200)],
    ):
        kept = li.keep_identified(spark.createDataFrame(rows, DOCUMENTS)).collect()
        assert sorted(map(tuple, kept)) == sorted(r for r in rows if li.has_letter(r[1]))


def test_the_classifier_rejects_what_it_never_learned(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    strange = [
        "xq zvkj qqwx pfgh jjkz xcvb qwrt zxcv bnmk lkjh " * 5,
        "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί",
        "敏捷的棕色狐狸跳过懒狗然后跑进森林",
        "Быстрая коричневая лиса прыгает через ленивую собаку и убегает далеко в лес",
    ]
    more = spark.createDataFrame([(10**6 + i, t, None, "odd", len(t)) for i, t in enumerate(strange)], DOCUMENTS)
    kept = [r["doc_id"] for r in li.keep_identified(docs.unionByName(more)).collect()]
    # Held-out documents, which set no bound, stay as the others do.
    assert sorted(kept) == sorted(r["doc_id"] for r in docs.collect() if li.has_letter(r["text"]))


def test_the_bound_keeps_held_out_documents():
    rows = pq.read_table(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").to_pylist()
    rows = [r for r in rows if r["lang"] and li.has_letter(r["text"])]
    out = [zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows]
    x, langs = np.stack([li.features(r["text"]) for r in rows]), np.array([r["lang"] for r in rows])
    read = ~np.array(out)
    model, bound = li.fit(x[read], langs[read].tolist()), li.margin_bound(x[read], langs[read].tolist())
    assert (bound > 0).all()
    assert li.speaks(li._judge(model, x[~read])[2], bound).all()
    assert not li.speaks(np.array([[0.9, 0.9]]) * bound, bound).any()
    assert li.speaks(np.array([[1.1, 0.0], [0.0, 1.1], [np.nan, 1.1], [np.nan, np.nan]]) * bound, bound).all()


def _lettered(spark, n, rare=3):
    """Documents of two common languages and a rare one, each of letters of its own."""
    rng = np.random.default_rng(5)
    own = {"de": "abcd", "nl": "abce", "fr": "pqrs"}
    rows = []
    for i in range(n):
        lang = "fr" if i < rare * 3 else ("de", "nl")[i % 2]
        rows.append((i, " ".join("".join(rng.choice(list(own[lang]), 4)) for _ in range(30)), lang, "a", 1))
    return spark.createDataFrame(rows, DOCUMENTS)


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 40)
    docs = _lettered(spark, 400)
    dealt = li._dealt(docs).collect()
    assert {(r["lang"], r["place"]) for r in dealt} == {(r["lang"], r["place"]) for r in dealt if r["first"]}
    assert sum(r["first"] for r in dealt) == 400
    blocks = {r["block"] for r in dealt}
    assert len(blocks) == 10 and {r["block"] for r in dealt if r["lang"] == "fr"} == blocks
    (model,) = li._mean_models(li._dealt(docs), 1)
    assert model.langs == [["de", "nl"], ["fr"]] and list(model.pairs[0]) == [(0, 1)]
    got = li.language_report(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, li.language_report(docs.repartition(7).unionByName(docs.limit(0))).collect()))


def test_the_weakest_row_of_all_sets_the_bound(spark, monkeypatch):
    # More rows than a sample of 4,000 held; the one row that differs sets the bound wherever it stands.
    docs = spark.range(9_000).selectExpr(
        "id AS doc_id", "concat(if(id % 2 = 0, 'abcd dcba abab ', 'abce ecba aeae '), 'acca ', id) AS text", "if(id % 2 = 0, 'de', 'nl') AS lang"
    )
    odd = spark.createDataFrame([(10**6, "abcd abce xyzw wzyx yyzz", "de")], "doc_id long, text string, lang string")
    _, bound = li._learned_from_all(docs, bounded=True)
    _, lower = li._learned_from_all(docs.unionByName(odd), bounded=True)
    assert (lower[1:] < 0.9 * bound[1:]).all()


def test_one_block_gives_the_machines_of_a_plain_fit(spark):
    docs = _lettered(spark, 300)
    (model,) = li._mean_models(li._dealt(docs), 1)
    rows = sorted((r["lang"], r["place"], r["features"]) for r in li._dealt(docs).collect())
    plain = li.fit(np.stack([li._unpacked(r[2]).astype(np.float32) for r in rows]), [r[0] for r in rows])
    assert model.families == plain.families and np.allclose(model.family_weights, plain.family_weights, atol=1e-5)
    assert all(np.allclose(model.pairs[0][k], w, atol=1e-5) for k, w in plain.pairs[0].items())


def test_a_row_that_comes_often_is_learned_once(spark):
    docs = _lettered(spark, 300)
    a, b = (li._mean_models(li._dealt(d), 1)[0] for d in (docs, docs.unionByName(docs).unionByName(docs.limit(50))))
    assert np.array_equal(a.family_weights, b.family_weights)


def test_no_row_that_was_learned_from_is_rejected(spark):
    # The machines of all rows see a text of one letter weaker than those of a half do.
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.1')}/documents.parquet")
    kept = {r["doc_id"] for r in li.keep_identified(docs).select("doc_id").collect()}
    assert [r["doc_id"] for r in docs.collect() if li.has_letter(r["text"]) and r["doc_id"] not in kept] == []


def test_machines_look_at_few_rows_and_take_the_same_steps(monkeypatch):
    rng = np.random.default_rng(3)
    own = rng.integers(0, 3, 600)
    x = np.zeros((600, 90), np.float32)
    x[:, :60] = rng.random((600, 60)) * (rng.random((600, 60)) < 0.3)
    x[np.arange(600), own] += 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sides = [np.where(own == 0, 1, -1), np.where(own == 1, 1, np.where(own == 2, -1, 0)), np.where(own > 0, 0, 1)]
    sides = [s.astype(np.float32) for s in sides]

    y = np.stack(sides, axis=1)
    share = np.where(y > 0, 0.5 / np.maximum(1, (y > 0).sum(axis=0)), 0.5 / np.maximum(1, (y < 0).sum(axis=0)))
    full = np.column_stack([x, np.full(len(x), li._BIAS)]).astype(np.float64)
    w = step = np.zeros((3, 91))
    for _ in range(li._ROUNDS):
        miss = np.maximum(0, 1 - y * (full @ w.T)) * y * share
        step = 0.9 * step - li._DECAY * w + miss.T @ full
        w = w + li._RATE * step

    seen, margins = [], li._margins
    monkeypatch.setattr(li, "_margins", lambda rows, weights: seen.append(len(rows)) or margins(rows, weights))
    assert np.allclose(li._machines(x, sides), w, atol=1e-4)
    assert sum(seen) < 0.7 * li._ROUNDS * len(x)
    assert li._machines(x[:0], [s[:0] for s in sides]).shape == (3, 91)


def _words(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))


def test_the_pipeline_learns_from_every_labelled_row(spark):
    # Two languages come only in rows that op7 holds out, or that have no id.
    rng = np.random.default_rng(6)
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 3 == 1][:10]
    rare = [(i, _words(rng, "αβγδε", 30), "el", "a", 1) for i in held]
    rare += [(None, _words(rng, "джзик", 30), "ru", "a", 1) for _ in range(10)]
    docs = _lettered(spark, 400, rare=0).unionByName(spark.createDataFrame(rare, DOCUMENTS))
    assert sorted(map(str, li.keep_identified(docs).collect())) == sorted(map(str, docs.collect()))
    # op7 never reads them.
    assert {r["lang_pred"] for r in li.language_report(docs).collect()} == {"de", "nl"}


def test_a_short_row_sets_no_bound_for_long_texts(spark):
    rng = np.random.default_rng(7)
    # Letters that stand for every language say nothing.
    short = [(1000 + i, t, lang, "a", 1) for i, (t, lang) in enumerate((t, lang) for t in ("x", "y.", "z") for lang in ("de", "nl", "fr"))]
    strange = [(2000 + i, _words(rng, letters, n), None, "odd", 1) for i, (letters, n) in enumerate([("джзиклмн", 80), ("日月火水木金土", 60), ("mnop", 80)])]
    docs = _lettered(spark, 400).unionByName(spark.createDataFrame(short, DOCUMENTS))
    kept = li.keep_identified(docs.unionByName(spark.createDataFrame(strange, DOCUMENTS))).collect()
    assert sorted(map(str, kept)) == sorted(map(str, docs.collect()))


def test_what_no_language_has_learned_is_rejected_from_a_larger_table(spark):
    # The weakest of 10,000 rows, 'A.', is weaker than any long text of no language.
    docs = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    strange = [
        "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και φεύγει μακριά μέσα στο δάσος " * 2,
        "敏捷的棕色狐狸跳过懒狗然后跑进森林而小鸟在树上唱着春天里最后一首歌给远方的朋友听",
        "Быстрая коричневая лиса прыгает через ленивую собаку и убегает далеко в лес",
    ]
    more = spark.createDataFrame([(10**6 + i, t, None, "odd", len(t)) for i, t in enumerate(strange)], DOCUMENTS)
    kept = {r["doc_id"] for r in li.keep_identified(docs.unionByName(more)).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if li.has_letter(r["text"])}


def test_the_weakest_row_by_size():
    least = li._least_by_size({2: (20, 0.1), 5: (40, 0.3), 7: (60, 0.7), 9: (10, 0.8)})
    assert least.tolist() == [0.1] * 7 + [0.7] * 2 + [0.7] * 5
    assert li._least_by_size({3: (49, 0.4), 8: (1, -0.2)}).tolist() == [-0.2] * 14
    bound = li._slack(least, np.array([3.0, np.inf]))
    assert np.allclose(bound[0], 1.5 * least) and not bound[1].any()
    margins = np.array([[0.2, np.nan], [0.2, np.nan], [np.nan, np.nan]])
    assert li.speaks(margins, bound, np.array([6, 7, 7])).tolist() == [True, False, True]


def test_a_language_may_be_called_und(spark):
    docs = _lettered(spark, 300).withColumn("lang", li.F.when(li.F.col("lang") == "fr", "und").otherwise(li.F.col("lang")))
    assert li.keep_identified(docs).count() == docs.count()
