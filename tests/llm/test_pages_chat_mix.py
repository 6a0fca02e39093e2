"""HTML extraction, url filter, chat rotation and mixing."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from blamegrid.llm import chat, decontaminate, html, mixing, registry, urls

from ..duck import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


# --- html ---


@pytest.fixture(scope="module")
def model(spark):
    return html.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


CASES = {
    "<nav>a <a href=x>b</a></nav><article><h1>T</h1><p>Sign up: cookies.<p>all rights &amp; more<ul><li>one<li>two</ul><p><a href=y>link</a></article><footer>c</footer>": ["T", "Sign up: cookies.", "all rights & more", "one", "two", "link"],
    "<article><h1>T</h1><p>x</p><div class='ad'>buy</div><p>y</p><aside>side</aside><section class=comments><p>hi there.</p></section><form><p>f</p></form></article>": ["T", "x", "y"],
    "<body><header><h1>Site</h1></header><article>plain text only</article><div class='comments'><p>Great, thanks!</p></div>": ["plain text only"],
    "<article><p>a&#233; &lt;b&gt;\n\n c<br>d<script>'</p>'</script> e</p><p>broken off &am": ["aé <b> c d e", "broken off &am"],
    "<article><p>before <b>the end</b> <a href='/x": ["before the end"],
    "<!-- x --><style>p{}</style>": [],
    "</div></p><article></span><p>odd</article>": ["odd"],
}


@pytest.mark.parametrize("page", CASES)
def test_known_pages(model, page):
    blocks = html.leaf_blocks(page)
    assert [b.text for b, y in zip(blocks, model.decode(model.scores(blocks, {}))) if y] == CASES[page]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>a</p><svg-icon name='x'></svg-icon><p>b</p><title-bar>c</title-bar><select-box></select-box><object-view/><p>d</p><svg><text>no</text></svg></article>", ["a", "b", "c", "d"]),
        ("<article><p>a<svg/>b <SVG viewBox='0 > 0' />c<svg width=1><path d='m'/><text>no</text></svg>d</p><p>e</p></article>", ["ab cd", "e"]),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><math/><p>f</p></article>", ["so x=2 holds", "f"]),
        ("<article><p>a</p><script\n>'<p>no'</script><style/>no</style ><p>b</p></article>", ["a", "b"]),
    ],
)
def test_names_that_begin_like_elements_without_text(page, want):
    assert [b.text for b in html.leaf_blocks(page)] == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div><a href=/>Home</a> <a href=/a>About</a></div><div>{}</div><div>Copyright 2020 Somebody</div>", None),
        ("<table><tr><td><a href=/>Home</a></td><td>{}</td></tr></table>", None),
        ("<body class=blog><div id=primary><div class='hentry'><h2>A walk</h2>{}</div></div><div id=secondary><h3>Archives</h3><ul><li><a href=/5>May 2020</a></li></ul></div><div id=colophon>Powered by <a href=/w>Press</a></div>", ["A walk"]),
    ],
)
def test_pages_whose_markup_tells_nothing(model, page, want):
    said = ["The river rose on Monday and the lower town was under water by the evening, as it had been twice before.", "Nobody was hurt.", "The mayor says that the wall will be built at last, and that it will cost less than the floods of the last ten years did."]
    blocks = html.leaf_blocks(page.format("".join(f"<p>{x}</p>" for x in said)))
    assert [b.text for b, y in zip(blocks, model.decode(model.scores(blocks, {}))) if y] == (want or []) + said


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><!--><p>one</p><!-- x --><p>two</p><!---><p>three</p><!-- y --!><p>four</p></article>", ["one", "two", "three", "four"]),
        ("<article><p>so <span style='display:none'>not <span>seen</span> here</span> it <span>goes</span> on.</p></article>", ["so", "it goes on."]),
        ("<article><p>words</p><ins class='adsbygoogle'>Buy now</ins><cookie-banner>We use cookies</cookie-banner><p>more <x-word>words</x-word></p></article>", ["words", "more words"]),
    ],
)
def test_inline_parts_and_odd_comments(model, page, want):
    blocks = html.leaf_blocks(page)
    assert [b.text for b, y in zip(blocks, model.decode(model.scores(blocks, {}))) if y] == want


def test_sample_of_pages_without_ids(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("page_id", F.lit(None).cast("long"))
    seen = []
    original, html.train = html.train, lambda pages: seen.append(len(pages))
    try:
        html.fit(pages, sample_pages=100)
        html.fit(pages.limit(0))
    finally:
        html.train = original
    assert seen[0] > seen[1] + 20


def test_labelled_pages_are_learnt(model):
    for page, labels in html.labelled_pages():
        assert model.decode(model.scores(html.leaf_blocks(page), {})) == labels


def test_pages_of_other_kinds(spark, model):
    said = "<h1>Bees return</h1><p>Keepers on the coast count more hives than in any year since the cold winter.</p>"
    more = "<p>Most of them thank the rain.</p><ul><li>Clover</li><li>Heather</li></ul>"
    main = "Bees return\n\nKeepers on the coast count more hives than in any year since the cold winter.\n\nMost of them thank the rain.\n\nClover\n\nHeather"
    parts = [
        "<noscript>Scripts are off.</noscript>", "<div style='color:red;display:none'><p>Not to be seen by anyone.</p></div>", "<p hidden>Neither is this line.</p>",
        "<dialog open><p>Will you join us today?</p></dialog>", "<button>More</button>", "<div class='related-links'><a href=x>Ten kinds of honey</a></div>", "<form>Go<input></form>",
    ]
    pages = [f"<body><article>{said}{part}{more}</article></body>" for part in parts] + [f"{part}<div id=content>{said}{more}</div>" for part in parts[:4]]
    pages += [
        f"<div id=menu><a href=1>Start</a> <a href=2>Us</a></div><div>{said}{more}</div><div class=page-footer><p>Copyright 2020 by us.</p></div>",
        f"<table><tr><td class=sidebar><a href=1>Start</a><br><a href=2>News</a></td><td>{said}{more}</td></tr></table>",
        f"<article lang=en title=it's data-n=5\" >{said}{more}</article>", f"<article>{said}{more}</article><script a='>' b=\"</script>\">x<y</script>", f"<main>{said}<svg a='/>' b>no</svg>{more}</main>",
        f"<article style='border:none;overflow:hidden'>{said}{more}</article>",
    ]
    got = html.extract(spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string"), model).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict.fromkeys(range(len(pages)), main)


def test_tags_take_linear_time():
    for page in ('<svg a="b"' * 20_000, "<svg " + 'a="b" ' * 20_000 + ">x", "<p " + "a='b " * 20_000, "<script " + "='" * 20_000, "<" * 100_000, "<!--" * 20_000):
        html.leaf_blocks(page)


def test_pages_of_the_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = html.extract(pages, model).toPandas().set_index("page_id")
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        want = "\n\n".join(b.text for b in html.leaf_blocks(inner))
        assert got.loc[r["page_id"]].text == want and got.loc[r["page_id"]].n_chars == len(want)


def test_html_edges(spark, model):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<article>" + "<div>" * 5000 + "deep", "x"), (4, "u", "<article><p>" + "long " * 100_000, "x"), (4, "u", "<p>", "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 0), (2, 0), (3, 4), (4, 0), (4, 499_999)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
    assert html.fit(spark.createDataFrame([], "page_id long, url string, html string")).weights


def test_training_sample_is_bounded_in_blocks(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(html, "train", lambda pages: sizes.extend(len(y) for _, y in pages))
    pages = spark.createDataFrame([(k, "u", "<article>" + "<p>x y.</p>" * 5000) for k in range(5)], "page_id long, url string, html string")
    html.fit(pages, sample_chains=7)
    own = [len(labels) for _, labels in html.labelled_pages()]
    assert sizes[: len(own)] == own and len(sizes) == len(own) + 7 and max(sizes[len(own) :]) <= html.CHAIN


def test_extract_against_features_by_hand(spark, model):
    """The whole query on pages of other kinds, against scores added up by hand and all labelings tried."""
    from itertools import product

    pages = ["<div><p>One.</p><nav><a href=x>Two</a></nav></div><article><h1>T</h1><p>Three, four.</p></article>", "<main><p>a b c.<aside>d</aside></main><footer>e</footer>", "<p>lone</p>", None]
    rows = html.extract(spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string"), model).collect()
    for r in rows:
        blocks = html.leaf_blocks(pages[r["page_id"]] or "")
        score = [sum(model.weights.get(f, 0.0) for f in own) for own in html.features(blocks)]
        value = lambda y: sum(s for s, v in zip(score, y) if v) + sum(model.moves[a][b] for a, b in zip(y, y[1:]))
        best = max(product((0, 1), repeat=len(blocks)), key=value)
        assert r["text"] == "\n\n".join(b.text for b, v in zip(blocks, best) if v) and r["n_blocks"] == len(blocks)


def test_viterbi_against_brute_force():
    from itertools import product

    rng = random.Random(0)
    for _ in range(50):
        moves = [[rng.uniform(-2, 2) for _ in "01"] for _ in "01"]
        scores = [rng.uniform(-3, 3) for _ in range(rng.randrange(1, 8))]
        value = lambda y: sum(s for s, v in zip(scores, y) if v) + sum(moves[a][b] for a, b in zip(y, y[1:]))
        field = html.ChainField([], __import__("numpy").zeros(0), __import__("numpy").array(moves))
        assert tuple(field.decode(scores)) == max(product((0, 1), repeat=len(scores)), key=value)


# --- urls ---


def judged(spark, rows, **more):
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string"), **more).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}


def test_rules(spark):
    rows = [
        (1, "HTTP://A.Example.ORG/es/x?q#f", "", ""), (2, "https://example.org/en/12", "", ""), (3, "https://notexample.org/en/1", "", ""), (4, "x://b.com/de/", "", ""),
        (5, "x://b.com/fr", "", ""), (6, None, None, ""), (7, "no scheme", "", ""), (8, "x://org/", "", ""), (9, "x://b.net#/a", "", ""), (10, "x://c.org", "", ""),
    ]
    assert judged(spark, rows) == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("notexample.org", "/en/1", "org/", "allow"),
        4: ("b.com", "/de/", "com/de/", "block"), 5: ("b.com", "/fr", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("org", "/", "org/", "allow"),
        9: ("b.net", "", None, "allow"), 10: ("c.org", "", None, "allow"),
    }


def test_redirects_spread_blocks_but_allow_wins(spark, tmp_path):
    canonical = '<html><LINK REL="canonical" href="{}">'
    rows = [
        (1, "http://a.net/1", canonical.format("http://x.com/de/1"), ""), (2, "http://b.net/2", '<meta content="0; url=http://a.net/1?s=2" http-equiv=refresh>', ""),
        (3, "http://c.net/3", canonical.format("http://x.com/de/2"), ""), (4, "http://d.org/4", canonical.format("http://c.net/3"), ""), (5, "http://e.net/d/5", canonical.format("6"), ""),
        (6, "http://e.net/d/6", "", ""), (7, "http://x.com/de/1", "", ""), (8, "http://a.net/1#again", "", ""),
        (9, "http://a.net/1?s=2#x", canonical.format("/1"), ""), (10, "http://a.net/1?s=3", "", ""), (11, "http://f.net?id=1", canonical.format("http://x.com/de/?id=1"), ""), (12, "http://f.net?id=2", "", ""),
    ]
    got = judged(spark, rows)
    assert {k: v[3] for k, v in got.items()} == {
        1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "block", 10: "allow", 11: "block", 12: "allow"
    }
    spark.createDataFrame(rows, "page_id long, url string, html string, verdict string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert {r[0]: r[4] for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.OP5_SQL})").fetchall()} == {k: v[3] for k, v in got.items()}
    more = spark.createDataFrame([("http://e.net/d/6", "http://y.com/de/"), ("http://e.net/d/6", None)], "source string, target string")
    assert judged(spark, rows, edges=more)[5][3] == "block"
    assert judged(spark, []) == {}


# --- chat ---


def test_rotation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 2, "bob", None), (1, 1, "ann", "Hé!"), (1, 3, None, "x"), (2, 0, "system", "alone"), (None, 0, "ann", "a"), (1, 600, "ann", "late"), (None, 0, "ann", "a")]
    got = {(r["conv_id"], r["participant"], r["part"]): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, p, k) for p in ("ann", "bob", "unknown") for k in (0, 1)} | {(None, "ann", 0)}
    ann = got[(1, "ann", 0)]
    assert ann["text"] == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHé!<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nx<|im_end|>\n"
    assert [ann["text"][s["start"] : s["end"]] for s in ann["spans"]] == ["Hé!<|im_end|>"] and (ann["n_turns"], ann["n_trained"]) == (4, 1)
    assert got[(1, "bob", 1)]["spans"] == [] and got[(None, "ann", 0)]["n_turns"] == 2
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_parts_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE_ROWS", 5)
    monkeypatch.setattr(chat, "PREFIX", 2)
    rng = random.Random(5)
    rows = [(None, rng.choice([None, 0, 1, 9]), rng.choice(["ann", "bob", None]), rng.choice(["x", "xyz", "xyzz", None, "é"])) for _ in range(60)]
    rows += [(None, 2, "ann", "same")] * 23 + [(1, k, "ann", f"t{k}") for k in range(10)] + [(2, None, "bob", f"n{k}") for k in range(9)] + [(2, 4, "system", "late")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=4).collect()
    assert max(r["n_turns"] for r in got) == 4 and len({(r["conv_id"], r["participant"], r["part"]) for r in got}) == len(got)
    assert sorted(r["part"] for r in got if r["conv_id"] == 1) == [0, 1, 2] and sorted(r["part"] for r in got if r["conv_id"] == 2) == [0, 1, 2, 3]
    for conv, viewer in {(r["conv_id"], r["participant"]) for r in got}:
        part_of = lambda t: 0 if t is None else t // 4
        own = sorted((part_of(t), t is not None, t or 0, s or "unknown", x or "") for c, t, s, x in rows if c == conv)
        named = lambda s: "assistant" if s == viewer else s if s == "system" else f"user name={s}"
        want = "".join(f"<|im_start|>{named(s)}\n{x}<|im_end|>\n" for *_, s, x in own)
        parts = sorted((r for r in got if (r["conv_id"], r["participant"]) == (conv, viewer)), key=lambda r: r["part"])
        assert "".join(r["text"] for r in parts) == want
        assert all(r["text"][s["start"] : s["end"]].endswith("<|im_end|>") for r in parts for s in r["spans"])
        assert sum(r["n_turns"] for r in parts) == len(own) and sum(r["n_trained"] for r in parts) == sum(s == viewer for *_, s, _ in own)


def test_long_conversations_against_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, None if t is None else t + shift, rng.choice(["ann", "bob", "system", None]), rng.choice(["x", None, "é", "long " * 9]))
            for c, shift, n in ((None, 0, 1300), (1, 0, 700), (1, 1024, 1100), (2, 500, 40)) for t in (rng.choice([None, 0, 3, 30]) for _ in range(n))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = chat.op2_chat_rotation(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({chat.OP2_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and max(r[3] for r in want) == 512


# --- mixing ---


def mixed(spark, rows, **more):
    return mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long, taken string"), **more)


def test_targets_and_takes(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "a", "a", "b", "c", None]), rng.randrange(0, 50), "x") for k in range(900)]
    got = mixed(spark, rows, range_rows=20).toPandas()
    assert len(got) == 900 and (got.taken <= 3 * got["size"]).all() and (got.passes <= 3).all()
    total = got["size"].sum()
    assert got.groupby("source", dropna=False).target.first().sum() == pytest.approx(total)
    for source, own in got.groupby("source", dropna=False):
        assert own.source_size.iloc[0] == own["size"].sum()
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 1 and own.target.iloc[0] <= 3 * own["size"].sum()
    again = mixed(spark, list(reversed(rows)), range_rows=20).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert got.position.dropna().is_monotonic_increasing and got.position.dropna().between(0, 1).all()


def test_water_filling():
    sizes, weights = [10, 500, 490], [1, 2, 3]
    left, caps, targets = 1000.0, [3 * s for s in sizes], [0.0] * 3
    open_ = {0, 1, 2}
    while True:
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] > caps[k]]
        if not over:
            break
        for k in over:
            targets[k] = caps[k]
            left -= caps[k]
            open_.discard(k)
    assert [targets[k] or share[k] for k in range(3)] == [30, pytest.approx(388), pytest.approx(582)]


def test_water_filling_in_spark(spark):
    got = {r["source"]: r["target"] for r in mixed(spark, [(1, "a", 10, ""), (2, "b", 500, ""), (3, "c", 490, "")]).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(388), "c": pytest.approx(582)}


def test_curriculum_positions(spark):
    rows = [(k, s, 10, "") for k in range(2000) for s in ("early", "late")]
    got = mixed(spark, rows, weights=(1, 1), schedules=(((0, 2), (1, 0)), ((0, 0), (0.5, 0), (1, 2)))).toPandas()
    early, late = got[got.source == "early"].position, got[got.source == "late"].position
    for t in (0.25, 0.5, 0.75):  # the share placed by t is the integral of the schedule
        assert (early <= t).mean() == pytest.approx(2 * t - t * t, abs=0.01)
        assert (late <= t).mean() == pytest.approx(max(0.0, (2 * t - 1) ** 2) if t > 0.5 else 0, abs=0.01)
    with pytest.raises(ValueError):
        mixing.segments([(0, 0), (1, 0)])


def test_mix_edges(spark):
    assert mixed(spark, []).count() == 0
    got = mixed(spark, [(1, "a", 0, ""), (2, None, None, ""), (None, "b", 0, "")]).collect()
    assert len(got) == 3 and all(r["taken"] == 0 and r["position"] is None and r["target"] == 0 for r in got)
    same = mixed(spark, [(1, "a", 7, "")] * 5 + [(2, "b", 100, "")]).toPandas()
    assert same[same.source == "a"].taken.sum() == 45 or abs(same[same.source == "a"].taken.sum() - same[same.source == "a"].target.iloc[0]) <= 1


def test_rows_without_doc_id_are_no_one_key(spark):
    """A third of the rows alike in every column: dealt over many ranges, and the mix is what it is by hand."""
    rows = [(None, "a", 5, "")] * 300 + [(k, "a", 1 + k % 9, "") for k in range(300)] + [(k, "b", 700, "") for k in range(3)]
    got = mixed(spark, rows, range_rows=20).toPandas()
    own = got[got.source == "a"]
    assert len(own) == 600 and own.doc_id.isna().sum() == 300
    assert (own.taken <= 3 * own["size"]).all() and int(own.taken.sum()) == int(own.target.iloc[0])
    partly = own[(own.taken % own["size"]) > 0]
    assert len(partly) <= 1


def test_many_sources_are_filled_like_water(spark, monkeypatch):
    from blamegrid.operators import positions

    monkeypatch.setattr(positions, "RANGE_ROWS", 7)
    rng = random.Random(3)
    sizes = {f"s{k:03}": int(rng.paretovariate(0.6) * 3) for k in range(150)} | {None: 40}
    got = {r["source"]: r["target"] for r in mixed(spark, [(k, s, n, "") for k, (s, n) in enumerate(sizes.items())]).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):  # the level by bisection
        level = (low + high) / 2
        filled = sum(min(3 * n, weight[s] * level) for s, n in sizes.items())
        low, high = (level, high) if filled < sum(sizes.values()) else (low, level)
    assert got == {s: pytest.approx(min(3 * n, weight[s] * low), rel=1e-9) for s, n in sizes.items()}


def test_chat_columns_that_clash(spark):
    rows = [(1, 0, "ann", "hi", "p", 1, [2]), (1, 1, "bob", "ho", "p", 1, [2])]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, participant int, turns array<int>")).collect()
    assert sorted((r["participant"], r["part"], r["n_turns"]) for r in got) == [("ann", 0, 2), ("bob", 0, 2)]


def test_spans_of_masks_round_trip():
    import numpy as np

    mask = np.array([1, 1, 0, 1, 0, 0, 1], bool)
    assert decontaminate.spans(mask) == [[0, 2], [3, 4], [6, 7]] and F is not None
