"""Language, quality, licences, decontamination: small fixtures, brute force, held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from blamegrid.llm import decontaminate, language, licenses, quality
from blamegrid.llm.common import table

SF = "/root/testdata/sf0.01"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return ALNUM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


# --- language ---


def test_held_out_language(spark):
    got = language.op9_language_id(spark, SF).toPandas().merge(table(spark, SF, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert 150 < len(held) < 350 and (held.lang == held.lang_pred).mean() > 0.98


def test_whole_language_query_against_a_plain_one(spark):
    """The same steps without Spark: sample, a machine for each pair, family and language of every document."""
    from itertools import combinations
    from zlib import crc32

    docs = table(spark, SF, "documents").toPandas()
    texts = [(t or "").encode() for t in docs.text]
    vectors = [language.trigrams(t) for t in texts]
    train = sorted((d, v.tobytes(), lang) for d, v, lang in zip(docs.doc_id, vectors, docs.lang) if v is not None and lang and crc32(str(d).encode()) % 4 != 2)

    def node(classes, class_of):
        found = language.Node(classes)
        for a, b in combinations(range(len(classes)), 2):
            rows = [(np.frombuffer(v, np.float32), 1.0 if class_of(x) == classes[a] else -1.0) for _, v, x in train if class_of(x) in (classes[a], classes[b])]
            x, y = np.stack([r[0] for r in rows]), np.array([r[1] for r in rows])
            w = language.fit_svm(x, y)
            found.pairs.append((a, b))
            found.weights = np.vstack([*([] if found.weights is None else [found.weights]), w])
            found.logistic = np.vstack([*([] if found.logistic is None else [found.logistic]), language.fit_logistic(x @ w[:-1] + w[-1], y)])
        return found

    langs = sorted({lang for *_, lang in train})
    root = node(sorted({language.family(x) for x in langs}), language.family)
    plain = language.Identifier(root, {f: node([x for x in langs if language.family(x) == f], lambda x: x) for f in root.classes})
    want = dict(zip(docs.doc_id, zip(*plain.predict(texts))))
    for r in language.op9_language_id(spark, SF).collect():  # the table is smaller than the sample's bound
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-6)


def test_language_edges(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").limit(200)
    model = language.fit(docs)
    rows = [(1, None, 5), (2, "", 5), (3, "123 !? ...", 5), (4, "日本", 5), (5, "a", 5), (5, "a", 5), (6, "the " * 50_000, 5)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang_score int"), model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[1]["lang_score"] == 0.0
    assert got[4]["lang_pred"] != "und" and got[6]["lang_pred"] != "und"
    none = language.fit(docs.filter("false"))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    one = language.fit(docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in language.identify(docs, one).collect()} == {"en"}
    assert language.identify(docs.filter("false"), model).count() == 0


def test_families_then_languages(spark):
    model = language.fit(table(spark, SF, "documents").select("doc_id", "text", "lang"), 60)
    assert model.root.classes == ["germanic", "romance"] and model.inner["romance"].classes == ["es", "fr"]
    assert model.root.weights.shape == (1, language.DIM + 1)
    assert language.family("xx") == "only xx"


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 1] + 0.3 > 0, 1.0, -1.0)
    w = language.fit_svm(x, y, cost=100.0, epochs=200)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.98


# --- quality ---


def test_held_out_quality(spark):
    got = quality.op7_quality_classifier(spark, SF).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    both = got.merge(table(spark, SF, "labels").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(held) > 80 and (held.quality == held.predicted).mean() > 0.95


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "A word."), (3, "A word."), (4, "!!! ### " * 20_000), (5, "ok then, " * 30_000)]
    stats = quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(np.isfinite(r["stats"]).all() and len(r["stats"]) == quality.DIM for r in stats.collect())
    labels = lambda own: spark.createDataFrame(own, "doc_id long, quality int")
    for own, score in (([], 0.5), ([(3, 1), (4, None)], 1.0)):
        model = quality.fit(stats.join(labels(own), "doc_id").filter("quality IS NOT NULL").selectExpr("CAST(quality AS long) AS label", "stats"))
        assert {r["score"] for r in quality.apply(stats, model).collect()} == {score}
    model = quality.fit(stats.join(labels([(1, 0), (2, 0), (4, 0), (3, 1), (5, 1)]), "doc_id").selectExpr("CAST(quality AS long) AS label", "stats"))
    assert all(0 <= r["score"] <= 1 for r in quality.apply(stats, model).collect())
    assert quality.apply(stats.filter("false"), model).count() == 0
    kept = quality.score_texts(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS label"), model)
    assert kept.columns == ["doc_id", "text", "label", "score"] and kept.count() == len(rows)


def test_discriminant_is_the_textbook_formula(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, quality.DIM)) + 0.5
    y = rng.integers(0, 2, 300)
    x[y == 1] = x[y == 1] * 1.5 + 0.3
    model = quality.fit(spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(y, x)], "label long, stats array<double>"), 0.0, 0.0)
    density = []
    for k in (0, 1):
        own = x[y == k]
        s, m = np.cov(own.T, bias=True), own.mean(axis=0)
        density.append(np.log(len(own)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500))), abs=1e-6)


def test_held_out_density_is_what_the_rows_give(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k % 2), (rng.normal(size=quality.DIM) * (1 + k % 2) + k % 2).tolist()) for k in range(120)]
    frame = spark.createDataFrame(rows, "label long, stats array<double>")
    folds = {tuple(r["stats"]): r["fold"] for r in frame.selectExpr("stats", f"pmod(xxhash64(stats), {quality.FOLDS}) AS fold").collect()}
    total = np.zeros((quality.FOLDS, 2, quality.CELLS))
    for r in quality.moments(frame).collect():
        total[r["fold"], r["label"], r["cell"]] = r["total"]
    want = 0.0
    for f in range(quality.FOLDS):
        train = {k: np.array([x for y, x in rows if y == k and folds[tuple(x)] != f]) for k in (0, 1)}
        pooled = sum(len(x) * np.cov(x.T, bias=True) for x in train.values()) / sum(map(len, train.values()))
        for k, x in train.items():
            s = 0.8 * np.cov(x.T, bias=True) + 0.2 * pooled
            s = 0.9 * s + 0.1 * np.trace(s) / quality.DIM * np.eye(quality.DIM)
            for d in (np.array(own) - x.mean(axis=0) for y, own in rows if y == k and folds[tuple(own)] == f):
                want -= 0.5 * (np.linalg.slogdet(s)[1] + d @ np.linalg.solve(s, d))
    assert quality.held_out_density(total, 0.2, 0.1) == pytest.approx(want)


def test_whole_query_against_the_formula(spark):
    """Scores of all documents against a plain discriminant in numpy on the same training rows."""
    from zlib import crc32

    docs, labels = (table(spark, SF, n).toPandas() for n in ("documents", "labels"))
    x = np.array([quality.statistics((t or "").encode()) for t in docs.text])
    known = {d: int(q) for d, q in zip(labels.doc_id, labels.quality) if q in (0, 1) and crc32(str(d).encode()) % 3 != 1}
    model = quality.fit(quality.training_rows(quality.with_statistics(table(spark, SF, "documents")), table(spark, SF, "labels")))
    scores = {r["doc_id"]: r["score"] for r in quality.op7_quality_classifier(spark, SF).collect()}
    classes = [x[[known.get(d) == k for d in docs.doc_id]] for k in (0, 1)]
    plain = [np.cov(own.T, bias=True) for own in classes]
    pooled = sum(len(own) * s for own, s in zip(classes, plain)) / sum(map(len, classes))
    tried = []
    for p in quality.TO_POOLED:
        for i in quality.TO_IDENTITY:
            mixed = [(1 - p) * s + p * pooled for s in plain]
            tried.append([(1 - i) * s + i * np.trace(s) / quality.DIM * np.eye(quality.DIM) for s in mixed])
    found = [f @ f.T for f in model.factors]
    assert any(np.allclose(found, own, atol=1e-9) for own in tried)
    density = []
    for k, own in enumerate(classes):
        assert model.means[k] == pytest.approx(own.mean(axis=0))
        d = x - own.mean(axis=0)
        density.append(np.log(len(own)) - 0.5 * np.linalg.slogdet(found[k])[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(found[k]), d))
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))
    assert [scores[d] for d in docs.doc_id] == pytest.approx(want.tolist(), abs=1e-9)


def test_quality_columns_that_clash(spark):
    rows = [(1, "A word.", "a", 1, 2), (2, "!!! ###", "b", 1, 2), (3, "Two words.", "c", 1, 2), (4, "??? !!!", "d", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string, label int, score int")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (3, 1, "x"), (4, 0, "x"), (None, 1, "x")], "doc_id long, quality int, stats string")
    rows = quality.training_rows(quality.with_statistics(docs), labels)
    assert rows.columns == ["label", "stats"] and quality.score_texts(docs, quality.fit(rows)).count() == 4


# --- licences ---


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        sequences = [[rng.randint(1, 3) for _ in range(rng.randint(1, 8))] for _ in range(4)]
        automaton = licenses.SuffixAutomaton(sequences)
        stream = [rng.randint(1, 4) for _ in range(25)]
        parts = {}
        for k, s in enumerate(sequences):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    parts.setdefault(tuple(s[i:j]), set()).add((k, j))
        for i, (state, length) in enumerate(automaton.stream(stream)):
            assert length == max([0] + [n for n in range(1, i + 2) if tuple(stream[i + 1 - n : i + 1]) in parts])
            if length:
                assert automaton.ends[state] == parts[tuple(stream[i + 1 - length : i + 1])]


def test_base_places_against_brute_force(spark):
    got = licenses.op6_license_scan(spark, SF).toPandas().set_index("doc_id")
    docs = table(spark, SF, "documents").select("doc_id", "text").toPandas()
    for doc_id, text in zip(docs.doc_id, docs.text):
        own = words(text)
        places = [(i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for i in range(len(own)) if own[i : i + len(p)] == p]
        row = got.loc[doc_id]
        assert (row.n_words, row.n_base) == (len(own), len(places))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        if places:
            assert (row.first_word, row.last_word) == (min(places)[0], max(places)[0])


def test_license_chains():
    scan = licenses.LicenseScanner().scan
    mit = licenses.PASSAGES[0][1].split()
    broken = mit[:20] + ["oddly"] * 3 + mit[20:40] + mit[41:]
    got = scan(" ".join(["x"] * 10 + broken + ["y"]).encode())
    assert got["labels"] == ["mit"] and got["spans"][0]["first"] == 10 and got["spans"][0]["past"] == 10 + len(broken) and 0.9 < got["score"] < 1
    far = scan(" ".join(mit[:20] + ["oddly"] * 50 + mit[20:40]).encode())
    assert far["labels"] == [] and far["score"] < 0.5
    assert scan(b"")["score"] == 0.0 and scan(b"the mit licenses")["labels"] == []
    assert scan(b"MIT License, GNU General-Public License; Apache\nLicense")["base_labels"] == ["apache", "gpl", "mit"]
    assert scan(b"Licensed under CC BY-NC 4.0.")["labels"] == ["cc-by-nc"]


def test_whole_licences(spark, tmp_path):
    scanner = licenses.LicenseScanner()
    for label, text in licenses.LICENCES:
        got = scanner.scan(f"Copyright 2024 someone\n{text}\nint main() {{}}".encode())
        assert label in got["labels"] and got["score"] == 1.0
        whole = [s for s in got["spans"] if s["label"] == label and s["cover"] == 1.0 and s["past"] - s["first"] >= len(licenses.ascii_words(text))]
        assert whole
    words = [f"w{k}" for k in range(900)]
    (tmp_path / "Own-1.0.txt").write_text(" ".join(words))
    (tmp_path / "empty").write_text(" ... ")
    own = licenses.read_templates(spark, str(tmp_path))
    assert own == (("own-1.0", " ".join(words)),)
    broken = words[:300] + ["x"] * 5 + words[310:700] + words[705:]
    got = licenses.LicenseScanner(templates=licenses.TEMPLATES + own).scan(" ".join(broken).encode())
    assert got["labels"] == ["own-1.0"] and got["score"] == pytest.approx(885 / 900)


def test_matching_statistics_of_texts_against_brute_force():
    """Labels and spans of random texts made of pieces of templates: coverage as a plain search over the text finds it."""
    rng = random.Random(7)
    scanner = licenses.LicenseScanner()
    for _ in range(30):
        label, words = rng.choice(licenses.PASSAGES)
        words = words.split()
        cut = rng.randrange(3, len(words)) if len(words) > 4 else len(words)
        text = ["qq"] * rng.randrange(5) + words[:cut] + ["zz"] * rng.randrange(3) + (words[cut:] if rng.random() < 0.5 else [])
        got = scanner.scan(" ".join(text).encode())
        if "zz" not in text and len(text) >= len(words) and words == text[-len(words):]:
            assert label in got["labels"] and got["score"] == 1.0
        longest = max((n for i in range(len(text)) for n in range(len(text) - i, 0, -1) if any(text[i : i + n] == words[j : j + n] for j in range(len(words) - n + 1))), default=0)
        if longest >= licenses.MIN_MATCH:
            assert got["score"] >= longest / len(words) - 1e-12


def test_chain_cover_against_brute_force():
    from itertools import combinations

    rng = random.Random(2)
    for _ in range(80):
        matches = [(rng.randrange(30), rng.randrange(20), rng.randrange(2, 6)) for _ in range(rng.randrange(1, 6))]

        def cover(chain):
            total = chain[0][2]
            for (s, w, m), (start, where, n) in zip(chain, chain[1:]):
                gain = min(n, start + n - (s + m), where + n - (w + m))
                if s >= start or w >= where or s + m + 4 < start or gain <= 0:
                    return 0
                total += gain
            return total

        best = max(cover(c) for k in range(1, len(matches) + 1) for c in combinations(sorted(matches), k))
        assert licenses.chain_cover(matches, 4)[0] == best


def test_license_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "mit license", 1), (3, "mit license", 1), (4, "word " * 50_000 + "mit license", 1)]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels int")).collect()
    assert sorted((r["doc_id"], len(r["places"]), r["n_words"]) for r in got) == [(1, 0, 0), (2, 0, 0), (3, 1, 2), (3, 1, 2), (4, 1, 50_002)]
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- decontamination ---


def brute_hits(docs, items, n=10):
    rows = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, test in items:
            test = words(test)
            size = min(n, len(test))
            grams = {tuple(test[i : i + size]) for i in range(len(test) - size + 1)} if test else set()
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add(str(item_id))
        rows.append((doc_id, len(own), len(hit), sorted(found)))
    return sorted(rows)


@pytest.mark.parametrize("block_bytes", (1 << 20, 30))
def test_hits_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(k, text(rng.choice((0, 1, 5, 9, 10, 11, 14)))) for k in range(12)] + [(3, "b, A;b a"), (99, None), (100, "é É x")]
    docs = [(k, text(rng.choice((0, 3, 12, 60)))) for k in range(40)] + [(50, None), (51, ""), (52, "É... é É X y"), (52, "É... é É X y"), (53, "q " * 40_000)]
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, n_words string")
    got = decontaminate.scan_benchmark(frame, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert sorted((r["doc_id"], r["n_words"], sum(b - a for a, b in r["hit_spans"]), r["item_ids"]) for r in got) == brute_hits(docs, items)


def test_long_items_are_cut_without_loss(spark):
    rng = random.Random(6)
    long = " ".join(rng.choice("abcdef") for _ in range(300))
    bench = spark.createDataFrame([("long", long), ("short", "x y"), (None, "p " * 11), ("none", "...")], "item_id string, text string")
    rows = decontaminate.pieces(bench, 10, 50).collect()
    own = [bytes(r["words"]).decode().split() for r in rows if r["name"] == "long"]
    grams = lambda w: [tuple(w[i : i + 10]) for i in range(len(w) - 9)]
    assert len(own) > 5 and sorted(g for w in own for g in grams(w)) == sorted(grams(long.split()))
    assert max(len(r["words"]) for r in rows) <= 52 and sorted({r["name"] for r in rows}) == ["", "long", "short"]
    docs = [(k, long[at : at + 60]) for k, at in enumerate(range(0, 500, 7))]
    got = decontaminate.scan_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=50).collect()
    assert sorted((r["doc_id"], r["n_words"], sum(b - a for a, b in r["hit_spans"]), r["item_ids"]) for r in got) == brute_hits(docs, [("long", long), ("short", "x y"), ("", "p " * 11)])


def test_windows_of_one_hash(monkeypatch):
    """Windows that share their hash are told apart by their words."""
    plain = decontaminate.window_hashes
    monkeypatch.setattr(decontaminate, "window_hashes", lambda ids, starts, length, radix: plain(ids, starts, length, radix) * np.uint64(radix != decontaminate.RADIX[0]))
    block = decontaminate.TestWindows([("a", b"one two three"), ("b", b"two three four"), ("c", b"one two three")], 3)
    sizes, hits, items = block.scan([b"one two three four".split(), b"two three one".split(), []])
    assert sizes.tolist() == [4, 3, 0] and [h.tolist() for h in hits] == [[True] * 4, [False] * 3, []]
    assert [[block.names[i] for i in own] for own in items] == [["a", "b", "c"], [], []]


def test_actions(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    passage = "One two, three four five six seven eight nine TEN"
    docs = spark.createDataFrame([(1, f"Before. {passage}! After"), (2, "clean"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert cut == {1: "Before. ! After", 2: "clean", 3: None}
    seam = spark.createDataFrame([(1, f"one two three {passage} four five six seven eight nine ten end")], "doc_id long, text string")
    assert decontaminate.decontaminate(seam, bench, "spans").first()["text"] == " end"
    clash = docs.selectExpr("*", "7 AS n_words", "'own' AS item_ids")
    for action, ids in (("documents", [2, 3]), ("spans", [1, 2, 3])):
        got = decontaminate.decontaminate(clash, bench, action)
        assert got.columns == clash.columns and sorted((r["doc_id"], r["n_words"], r["item_ids"]) for r in got.collect()) == [(d, 7, "own") for d in ids]
    assert decontaminate.decontaminate(docs, bench.filter("false")).count() == 3
    assert decontaminate.decontaminate(docs.filter("false"), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, "lines")


# --- samples and long templates ---


def test_language_sample_is_bounded_whatever_the_ids(spark):
    """Null ids, one id for all, and rows that are the same many times over: the bound holds and all languages are learnt."""
    said = {"de": "Der Hund schläft heute unter dem Baum und träumt", "en": "The dog sleeps under the tree today and dreams", "fr": "Le chien dort aujourd'hui sous l'arbre et rêve"}
    rows = [(lang, f"{text} nr {k} von" if k < 1500 else text) for lang, text in said.items() for k in range(6000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for ids in (F.lit(None), F.lit(7), F.monotonically_increasing_id()):
        keyed = docs.withColumn("doc_id", ids.cast("long"))
        ends = language.least_keys(keyed.withColumn("key", language.row_key()), {x: 6000 for x in said}, 100)
        taken = keyed.withColumn("key", language.row_key()).groupBy("lang").agg(F.count_distinct(F.when(F.col("key") <= F.element_at(F.create_map(*(F.lit(v) for x in ends.items() for v in x)), F.col("lang")), F.col("key"))).alias("n"))
        assert {r["lang"]: r["n"] for r in taken.collect()} == dict.fromkeys(said, 100)
    model = language.fit(docs.withColumn("doc_id", F.lit(None).cast("long")), 60)
    langs, _ = model.predict([t.encode() for t in said.values()])
    assert langs == list(said)


def test_few_distinct_rows_are_all_learnt_from(spark):
    docs = spark.range(40_000).select(F.lit("de").alias("lang"), F.concat(F.lit("Satz "), F.col("id") % 3).alias("text"), F.lit(1).cast("long").alias("doc_id"))
    keyed = docs.withColumn("key", language.row_key())
    assert language.least_keys(keyed, {"de": 40_000}, 10)["de"] == keyed.agg(F.max("key")).first()[0]


def test_templates_that_repeat_a_word():
    scanner = licenses.LicenseScanner([("mit license", "mit")], [("loop", "la " * 3000), ("other", "words of another kind " * 5)])
    found = scanner.scan(b"MIT License " + b"la " * 3000)
    assert "loop" in found["labels"] and "mit" in found["labels"]
