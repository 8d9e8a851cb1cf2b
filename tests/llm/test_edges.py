"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; hot groups and parts."""

import hashlib
import itertools
import random
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, bpe_core, components, decontaminate, html_core, html_extract, line_dedup, quality, secrets, simhash, suffix_core, suffix_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, bytes string, h int, fp string, host string, kept boolean, line string, spans int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiouäé") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = prose(1, 30_000)
    texts = [(1, prose(2, 80)), (2, None), (3, ""), (None, prose(3, 90)), (None, None), (4, long), (5, long), (6, prose(2, 80)), (7, "  \n\t"), (8, "x" * 300_000), (9, prose(2, 80)), (9, prose(2, 80)), (10, "Ä ß 😀 \x00 end")]
    return [(i, t, None if k % 3 else "de", None if k % 4 else "s", None, 5, "b", 1, "f", "h", True, "l", 2) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (None, 1), (2, None), (1, 0), (6, 0), (6, 0)], "doc_id long, toxic int")


def bag(items):
    return sorted(items, key=str)


def removed_by_row(spark, rows):
    """doc_id, length and removed bytes of each row; rows of one doc_id and text are one document, in the operator's order."""
    texts = spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id long, text string").distinct()
    keyed = texts.select("doc_id", "text", F.xxhash64(F.col("text").cast("binary")).alias("x"), F.xxhash64(F.lit(1), F.col("text").cast("binary")).alias("y")).collect()
    order = [(r.doc_id, r.text) for r in sorted(keyed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.x, r.y))]
    want = {k: (len(d), sum(m)) for k, (d, m) in zip(order, brute.suffix_masks(order), strict=True)}
    return bag((i, *want[i, t or ""]) for i, t in rows)


def removed(df):
    rows = df.collect()
    assert all(len(r.kept) == r.n_bytes - sum(s.end - s.start for s in r.spans) for r in rows)
    assert all(0 <= s.start < s.end <= r.n_bytes for r in rows for s in r.spans)
    return bag((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans)) for r in rows)


def test_op1(spark, docs, rows):
    assert removed(suffix_dedup.suffix_dedup(docs)) == removed_by_row(spark, [r[:2] for r in rows])
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_op1_ids(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_KEYS", most)
    shared = [prose(900 + k, 40) for k in range(6)]
    rows = [(None if i < 200 else 7 if i < 230 else i, f"{prose(i, 20)} {shared[i % 6]} {prose(i + 5000, 9)}") for i in range(260)]
    rows += [rows[0], rows[205], (-3, rows[9][1]), (None, None), (None, "")]
    assert removed(suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == removed_by_row(spark, rows)


def test_op1_rounds():
    data = np.frombuffer((prose(4, 40) + prose(4, 40)).encode(), np.uint8)
    half = len(data) // 2
    args = (np.array([0, half]), np.array([60, 60]), np.array([40, 40]), np.zeros(2, int), np.array([0, 1000]), 100)
    ctx, nth, rounds = suffix_core.refine(data, *args)
    # from 8 equal bytes to 16, 32, 64 and 100: each round reads what the last one has written
    assert rounds == 4 and ctx.tolist() == [1] * 40 and sorted(nth.tolist()) == [*range(40)]


@pytest.mark.parametrize("hot", [2, 50_000])
def test_op1_hot_buckets(spark, hot):
    core = prose(11, 60)
    rows = [(i, prose(100 + i, 30) + core + prose(200 + i, 30)) for i in range(40)] + [(50, core[:99]), (51, core[:100]), (52, "ab" * 400), (53, "xab" + "ab" * 300)]
    got = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert got == {i: sum(m) for (i, _), (_, m) in zip(rows, brute.suffix_masks(rows), strict=True)}


def test_op2(spark, docs):
    items = spark.createDataFrame([(1, prose(2, 30)), (2, None), (3, ""), (4, "too short"), (None, prose(77, 20)), (1, prose(2, 30))], "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("w", F.lit(2))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1), (6, 1), (9, 1)}
    assert decontaminate.leaks(docs.limit(0), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 4


@pytest.mark.parametrize("most", [200_000, 0])
def test_op2_rows(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", most)
    item = lambda i: prose(700 + i, 20)
    rows = [(i, side) for i in (None, 1, 2) for side in (f"{prose(1, 9)} {item(1)}", f"{prose(1, 9)} {prose(40, 20)}", f"{prose(1, 9)} {item(2).rsplit(' ', 9)[0]}")]
    rows += [(3, f"{prose(2, 9)} {item(k)}") for k in (3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # items of one item_id begin alike, so that one place and shift is found in both
    alike = [f"{item(5)} {prose(800, 3)}", f"{item(5).rsplit(' ', 12)[0]} {prose(801, 15)}"]
    items = spark.createDataFrame([(1, item(1)), (None, item(3)), (1, item(4)), (8, alike[0]), (8, alike[1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(None, 1), (1, 1), (2, 1), (3, None), (3, 1)}
    left = bag((r.doc_id, r.text) for r in decontaminate.decontaminate(docs, items).collect())
    assert left == bag(r for k, r in enumerate(rows) if k in (1, 2, 4, 5, 7, 8))
    whole = spark.createDataFrame([(20, text) for text in alike], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_equal) for r in decontaminate.leaks(whole, items).collect()] == [(20, 8, 13)]
    assert decontaminate.decontaminate(whole, items).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_op2_every_length(spark, monkeypatch, most):
    """Items of 1 to 15 words, each with all substitutions that its length allows and with one more."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", most)
    items, rows = {}, []
    for n in range(1, 16):
        words = [f"w{n}x{k}" for k in range(n)]
        items[n] = " ".join(words)
        for change in (c for m in range(4) for c in itertools.combinations(range(n), m)):
            text = ["zz" if k in change else w for k, w in enumerate(words)]
            rows.append((len(rows), " ".join(["intro", *text, "end"])))
    rows += [(len(rows) + k, " ".join(items[15].split()[k:])) for k in range(15)]
    got = {(r.doc_id, r.item_id, r.n_equal) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items.items()], "item_id long, text string")).collect()}
    assert got == {(i, k, n) for i, t in rows for k, n in brute.leaks(t, [*items.items()]).items()}
    assert {k for _, k, _ in got} == {*items}


def test_op2_substitutions(spark):
    words = prose(5, 40).split()
    changed = [f"zz{i}" if i % 6 == 5 else w.upper() + "," for i, w in enumerate(words)]
    far = [f"zz{i}" if i % 2 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "intro here. " + " ".join(changed) + " outro"), (2, " ".join(far)), (3, prose(6, 60))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()] == [(1, 7)]


def test_op3(spark):
    page = lambda i: f"<html><body><div class='top'>Site</div><div class=links><a href=1>One {i}</a></div><div class=c><p>Text {i}.<p>More&nbsp;text &amp; {i * 7}</div><div id='comments'><p>Me {i} too</div><div class='x'>Copyright</div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(100, None, None), (101, "x", ""), (None, "http://one.example/", "<p>alone"), (102, "http://one.example/", "<main><h1>T</h1><aside>no</aside><p>a<br>b <b>c</b></main><footer>f</footer>"), (103, "u", "<script>var t='</p>'</script>plain <!-- no --> text"), (103, "u", "<scr")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("host", F.lit("h")).withColumn("model", F.lit(1))
    got = bag((r.page_id, r.text) for r in html_extract.extract_text(df).collect())
    want = [(i, f"Text {i}.\nMore text & {i * 7}") for i in range(12)] + [(100, ""), (101, ""), (None, "alone"), (102, "T\na b c"), (103, "plain text"), (103, "<scr")]
    assert got == bag(want)
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_op3_inside_article(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><div class='k'>Published by Example House</div><p>Text {i}</p><ul><li><a href=1>More {i}</a></ul></article><p>Imprint</body>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(12)] + [(100 + i, "http://copies.example/", page(0)) for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nText {i}" for i in range(12))
    assert all("Title 0\n" in got[100 + i] and "Text 0" in got[100 + i] for i in range(12))


def test_op3_comments_and_layouts(spark):
    """Nested comment articles, a constant paragraph beside varying ones, and a second layout with its own template."""
    first = lambda i: f"<body class='has-sidebar'><article class='post'><h1>T {i}</h1><p>First {i}</p><p>Read our house rules.</p><p>Last {i}</p><article class='comment'><p>Me too {i}</p></article></article></body>"
    second = lambda i: f"<body><div class='k'><table><tr><td>Story {i} goes on</td></tr></table><ul class='z'><li>Printed by Example Press</li></ul></div></body>"
    rows = [(i, f"http://h.example/{i}", first(i)) for i in range(14)] + [(100 + i, f"http://h.example/b{i}", second(i)) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T {i}\nFirst {i}\nLast {i}" for i in range(14)} | {100 + i: f"Story {i} goes on" for i in range(8)}


def test_op3_names_in_articles(spark):
    """Names that articles use too do not lose their text; around links, comments and adverts the same names still do."""
    text = "<h1>Trees</h1><section id='discussion'><h2>Discussion</h2><p>We discuss {i}.</p></section><h2 id='search'>Search trees {i}</h2><p class='alert'>Take care of {i}.</p><div class='notice'><p>Note {i} well.</p></div><div class='related'><p>Related work by {i}.</p></div><h3 class='comments'>Comments on {i}</h3><p>E is <math>mc{i}</math> done</p>"
    rest = "<div class='related'><ul><li><a href=1>Other story {i}</a></li><li><a href=2>Next {i}</a></li></ul></div><section class='discussion'><article class='comment'><p>First! {i}</p></article><article class='comment'><p>Me too {i}</p></article></section><div class='alert'><div class='advert'>Buy {i}</div></div>"
    want = "Trees\nDiscussion\nWe discuss {i}.\nSearch trees {i}\nTake care of {i}.\nNote {i} well.\nRelated work by {i}.\nComments on {i}\nE is mc{i} done"
    rows = [(i, f"http://one{i}.example/", f"<body><div class='menu'>Home {i}</div><article>{(text + rest).format(i=i)}</article></body>") for i in range(3)]
    rows += [(10 + i, "http://many.example/", f"<body><main>{(text + rest).format(i=i)}</main><div class='notice'>We use {i}</div></body>") for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want.format(i=k % 10) for k, _, _ in rows}
    # an element that the next one ends has nothing of what follows
    texts = lambda h: [t for _, t, _ in html_core.parse(f"<article>{h}</article>").blocks]
    assert texts("<p class=alert><a href=1>Link</a><p>Much more text than the link has") == ["Much more text than the link has"]
    # without an article, at a host of one page
    bare = "<body><div class='nav'>Home</div><h2 id='search'>Search trees</h2><p>Text</p><div id='notice'>By the way</div><div class='alert'>We use cookies</div><div id='comments'>Hi</div></body>"
    got = html_extract.extract_text(spark.createDataFrame([(1, "http://x.example/", bare)], "page_id long, url string, html string")).first()
    assert got.text == "Search trees\nText\nBy the way"


def test_op3_broken(spark):
    texts = lambda h: [t for _, t, _ in html_core.parse(h).blocks]
    assert texts("<body><p>one</p><svg><path></p><p>two</p>") == ["one", "two"]
    assert texts("<p title=it's>one</p><p>two</p>") == ["one", "two"]
    assert texts("<p>a <button>x<div>y</div></button> b</p><p>c") == ["a b", "c"]
    assert texts("<div>a<object><p>x</p></div><p>after</p>") == ["a", "after"]
    assert texts("<p>1<select><option>a<option>b</select>2<iframe>3<p>c") == ["1 2 3", "c"]
    assert texts('<p>a <a href="x>link</a> b<p>c') == ["a link b", "c"]
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    broken = ["<a b" * 250_000, '<a b="x' * 140_000, "<p t=' " * 140_000, '<a b=">" ' * 110_000, "<" * 1_000_000, "<button>" * 120_000, "<p>x" * 100_000, deep]
    rows = [(i, "http://h.example/", h) for i, h in enumerate(broken)]
    began = time.monotonic()
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got[7] == "deep" and got[6] == "\n".join(["x"] * 100_000) and time.monotonic() - began < 120


def test_tree_matching():
    r = random.Random(4)

    def plain(la, ca, lb, cb, a, b):
        if la[a] != lb[b]:
            return 0
        x, y = ca[a], cb[b]
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x, 1):
            for j, q in enumerate(y, 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain(la, ca, lb, cb, p, q))
        return m[-1][-1] + 1

    def tree(n):
        lines, used = ["-1 "], {}
        for i in range(1, n):
            parent = r.randrange(i)
            label = r.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c not in used.setdefault(parent, set())])
            used[parent].add(label)
            lines.append(f"{parent} {label}")
        return "\n".join(lines)

    for _ in range(40):
        x, y = tree(r.randint(1, 25)), tree(r.randint(1, 25))
        assert sum(n >= 0 for n in html_core.align(x, y)) == plain(*html_core._tree(x), *html_core._tree(y), 0, 0)

    a = "-1 \n0 html\n1 body\n2 div.a\n2 p\n2 div.b"
    b = "-1 \n0 html\n1 body\n2 div.b\n2 div.a\n2 div.b"
    assert html_core.align(a, a) == [0, 1, 2, 3, 4, 5]
    assert html_core.align(a, b) == [0, 1, 2, 4, -1, 5]


def test_op4(docs, labels, rows):
    for known in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.toxicity(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_lexicon():
    lex = toxicity.Lexicon(["idiot", "scum"], ["lowei"], frozenset(["ideot"]), [])
    assert [lex.match(w) for w in ("idiot", "idoit", "idiots", "diot", "ideot", "scum", "scam", "loweihund", "lowe", "idi")] == [0, -1, 1, 1, -1, 0, -1, 2, -1, -1]


def test_lexicon_against_all_edits():
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abc0") for _ in range(n))
    terms, words = sorted({word(r.randint(4, 7)) for _ in range(12)}), {word(r.randint(3, 8)) for _ in range(3000)}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    lex = toxicity.Lexicon(terms, [])
    for w in words:
        best = min((edits(t, w) for t in terms if edits(t, w) <= (len(t) >= 5)), default=-1)
        assert lex.match(w) == best
    assert all(toxicity.within_one(t, w) == (edits(t, w) <= 1) for t in terms for w in [*words][:300])
    assert toxicity.neighbours(terms, [*words]) == {t: sum(edits(t, w) == 1 for w in words) for t in terms}


def test_op4_quotation_and_spelling():
    lex = toxicity.Lexicon(["idiot", "moron"], [])
    share = lambda t: toxicity.catch_features(t, lex)[4]
    assert all(share(f"he was a {a}real idiot indeed{b} to us") == 1 for a, b in ('""', "“”", "„“", "«»", "‘’"))
    assert share('"fine" you idiot, "really"') == 0 and share("“fine” you idiot, “really”") == 0 and share("you idiot") == 0
    assert [lex.match(w) for w in toxicity.WORD.findall("m0ron id!ot moron2 2 idiots")] == [1, 1, 0, 1]


def test_op4_learns(spark):
    r = random.Random(0)
    rows, known = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = prose(i, 40).split()
        if bad:
            words[r.randrange(40)] = r.choice(["blarghead", "zorkface"])
        rows.append((i, " ".join(words)))
        known.append((i, int(bad)))
    rows += [(9000, prose(9000, 30) + " you blarghaed no"), (9001, prose(9001, 30) + " you blargheat no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, spark.createDataFrame(known, "doc_id long, toxic int")).collect()}
    assert all(got[i].predicted == y for i, y in known)
    assert got[9001].predicted == 1


def test_op5(docs, rows):
    got = secrets.secret_spans(docs).collect()
    assert len(got) == len(rows) and secrets.secret_spans(docs.limit(0)).count() == 0


def test_op5_field(spark):
    r = random.Random(1)
    code = lambda n, i: "".join(r.choice("0123456789abcdef" if i % 2 else "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_") for _ in range(n))
    rows = [(i, f"{prose(i, 20)} token = \"{code(40, i)}\" {prose(i + 999, 20)} é 12.34.56.{i} a.b{i}@mail7.example.com") for i in range(60)]
    kinds = ["ghp_" + code(36, 0), "sk-" + code(40, 0), "Authorization: Bearer " + code(40, 0), "eyJ" + code(30, 0) + "." + code(60, 0)]
    rows += [(200 + i, f"{prose(7000 + i, 30)} {kinds[i % 4]} {prose(8000 + i, 30)}") for i in range(40)] + [(300 + i, prose(9000 + i, 400)) for i in range(20)]
    rows.append((100, "é my token \"ghp_16C7e42F292c6912E7710c838347Ae178B4a\" and secret=short token=secret: abcdef123456xyz"))
    rows.append((101, "visit 77.12.34.56 http://example.com/a/b/c1234567 mail a.b12@mail7.example.com"))
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans] for x in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    assert any(k == "crf" and text[100][a:b].startswith("ghp_") for k, a, b in got[100]) and not got[101]
    # kinds that no pattern knows are found, and plain texts have none
    assert sum(any(k == "crf" for k, _, _ in got[200 + i]) for i in range(40)) >= 36 and not any(got[300 + i] for i in range(20))
    for i, t in rows:
        base = [s for s in got[i] if s[0] != "crf"]
        assert (sum(k == "assign" for k, _, _ in base), sum(k == "hex" for k, _, _ in base)) == (brute.secrets(t)[0], brute.secrets(t)[2])


def test_op5_rare(spark):
    r = random.Random(2)
    code = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, prose(i, 12) + " 2024") for i in range(400)] + [(1000 + i, f'{prose(i, 12)} token = "{code()}" {prose(i, 9)}') for i in range(8)]
    assert secrets.train(spark.createDataFrame(rows, "doc_id long, text string"), 8) is not None
    found = spark.createDataFrame(rows, "doc_id long, text string").where(F.col("text").rlike(secrets._ANY))
    assert {x.doc_id for x in found.collect()} == {i for i, t in rows if secrets.base_spans(t.encode())}
    assert secrets.train(spark.createDataFrame(rows[:400], "doc_id long, text string"), 8) is None


@pytest.mark.parametrize("copies", [500, 20_000])
def test_op5_copies(spark, copies):
    """Copies of one text with a find neither silence the field nor fill its sample."""
    code = "ghp_16C7e42F292c6912E7710c838347Ae178B4a"
    other = spark.createDataFrame([(copies + i, f'{prose(i, 12)} token = "{hashlib.sha1(str(i).encode()).hexdigest()}" {prose(i + 99, 9)}') for i in range(40)] + [(-1, f"{prose(3, 9)} {code} {prose(4, 9)}")], "doc_id long, text string")
    same = spark.range(copies).select(F.col("id").alias("doc_id"), F.lit(f'{prose(8, 12)} token = "{"0a1b2c3d4e" * 4}" {prose(9, 9)}').alias("text"))
    for docs in (same.unionByName(other), same.unionByName(other.where("doc_id = -1"))):
        assert [(s.kind, s.end - s.start) for s in secrets.secret_spans(docs).where("doc_id = -1").first().spans] == [("crf", len(code))]


def test_viterbi_is_best():
    g = np.random.default_rng(0)
    field = secrets.Field(g.normal(size=(4, 3)), g.normal(size=(3, 3)))
    field.step[0, 2] = -1e9
    x, may = g.normal(size=(6, 4)), np.array([1, 1, 0, 1, 1, 1], bool)

    def score(tags):
        s = x @ field.emit
        total = sum(s[i, t] if may[i] or t == 0 else -1e9 for i, t in enumerate(tags)) + (-1e9 if tags[0] == 2 else 0)
        return total + sum(field.step[a, b] for a, b in itertools.pairwise(tags))

    best = max(itertools.product(range(3), repeat=6), key=score)
    assert field.decode(x, may) == list(best)


def test_op6(spark):
    big = "Aé" * 1_500_000
    rows = [(1, None, None), (2, "http://x/é y%20\n", ""), (3, "u", None), (4, "u", "dup"), (5, "u", "dup"), (None, "u", "dup"), (6, "big", big), (7, "u", "one")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(0)).withColumn("digest", F.lit("x"))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.url) for r in warc.archive_roundtrip(pages).collect()}
    assert got == {1: ("revisit", 3, 0, None), 2: ("revisit", 3, 0, rows[1][1]), 3: ("response", None, 0, "u"), 4: ("revisit", 5, 3, "u"), 5: ("response", None, 3, "u"), None: ("revisit", 5, 3, "u"), 6: ("response", None, 4_500_000, "big"), 7: ("response", None, 3, "u")}
    chunks = warc.read_chunks(warc.write_archives(pages)).where("page_id = 6").orderBy("chunk").collect()
    assert len(chunks) > 2 and b"".join(bytes(c.data) for c in chunks) == big.encode()
    assert [c.seen for c in chunks] == sorted(c.seen for c in chunks) and [c.last for c in chunks] == [False] * (len(chunks) - 1) + [True]
    assert chunks[-1].digest == chunks[-1].stated
    assert all(r.record_type == "response" for r in warc.archive_roundtrip(pages, min_bytes=4).collect())
    assert warc.archive_roundtrip(pages.limit(0)).count() == 0


def test_op7(docs, rows):
    out = line_dedup.line_dedup(docs, report=True)
    assert out.count() == len(rows) and out.columns == [*docs.columns, "n_lines", "n_dropped"]
    want = brute.site_lines([(r[0], r[1] or "", r[3]) for r in rows])
    assert bag((r.doc_id, r.text) for r in out.collect()) == bag((r[0], t) for r, t in zip(rows, want, strict=True))
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_op7_ratio(spark, monkeypatch):
    rows = [(i, f"head\nown {i}\n head \n\nfoot {i % 2}", "a") for i in range(20)] + [(100 + i, "copy\nof one page", "b") for i in range(20)] + [(200 + i, f"head\nx{i}", None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for distinct in (False, True):
        want = dict(zip([r[0] for r in rows], brute.site_lines(rows, distinct=distinct), strict=True))
        for most in (200_000, 0):
            monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
            assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs, distinct=distinct).collect()} == want
        assert want[0] == "own 0\n" and want[100] == ("copy\nof one page" if distinct else "") and want[200] == "head\nx0"


def test_op8(docs, rows):
    got = bpe.bpe_roundtrip(docs, ids=True).collect()
    assert bag((r.doc_id, r.n_tokens) for r in got) == bag((r.doc_id, len(r.ids)) for r in bpe.bpe_encode(docs).collect())
    assert len(got) == len(rows) and bpe.bpe_roundtrip(docs.limit(0)).count() == 0
    text = {r.doc_id: r.text for r in bpe.bpe_decode(bpe.bpe_encode(docs), as_bytes=True).collect()}
    assert text[10] == "ä ß 😀 \x00 end "
    digest = {r.doc_id: r.text_sha256 for r in got}
    assert all(digest[i] == hashlib.sha256(t.encode()).hexdigest() for i, t in text.items() if i is not None)


def test_op8_streams():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = bpe_core.WordBpe(path), Tokenizer.from_file(path)
    r = random.Random(3)
    texts = ["a" * 5000, "abcab" * 3000, "#" * 3000, "".join(r.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(20_000)), "a<|endoftext|>b <|startoftext|>", "İ ΑΣ Σ'S don't I'LL ﬁ ½ \u0085\x1c日本語 ǅ", "é é ́abc"]
    for t in texts:
        ids = [i for w in t.encode().split() for i in own.ids(w.decode())]
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert bpe_core.TokenText(own.text).feed(ids) == lib.decode(ids, skip_special_tokens=False)
    # words side by side give what each gives alone
    words = sorted({texts[3][k : k + r.randint(1, 40)].encode() for k in range(0, 19_000, 7)} | {b"a", b"ab", b"abc", b"abca"})
    assert [*own.transducer.encode_all(words)] == [[*own.transducer.encode([w])] for w in words]
    fresh = bpe_core.WordBpe(path)
    chunks = [w.decode(errors="ignore") for w in words[:500]] + ["don't,stop", "x<|endoftext|>y", "", "Σ'S"]
    assert all([*map(list, fresh.ids_of(chunks))] == [own.ids(c) for c in chunks] for _ in range(3))
    word = texts[3].encode()
    for most in (1, 7, 100, 50_000):
        blocks = [word[k : k + most] for k in range(0, len(word), most)]
        assert [*own.transducer.encode(blocks)] == own.ids(texts[3])
    # tokens come out long before the word ends, and what is held does not grow with it
    read = 0

    def letters():
        nonlocal read
        for b in word:
            read += 1
            yield bytes([b])

    stream = own.transducer.encode(letters())
    next(stream)
    assert read < 1000
    assert any(len(w) <= own.transducer.lookahead for w in ("abc", "the")) and not hasattr(own.transducer, "encode_short")
    machine = bpe_core.ByteText(own.text, own.special)
    assert "".join(machine.feed([i]) for i in own.ids("日本 ü")) + machine.feed((), final=True) == "日本 ü "


def test_op9(docs, rows):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows) and all(r.n_words == 0 and r.base_failed for r in got if r.doc_id in (2, 3, 7))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.quality_rules(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def test_op9_bands(spark):
    latin, cyrillic = b"Lorem ipsum dolor", "Слово за слово и ещё слово".encode()
    assert quality.band_of(latin, "en", quality.BANDS) is quality.BANDS["en"] and quality.band_of(latin, None, quality.BANDS) is quality.BANDS["Latin"]
    assert quality.band_of(cyrillic, "xx", quality.BANDS) is quality.DEFAULT_BAND and quality.band_of(b"", None, quality.BANDS) is quality.DEFAULT_BAND
    rows = [(i, prose(i, 80), "en" if i % 2 else "de") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bands = quality.fit_bands(docs, docs.select("doc_id", F.lit(1).alias("quality")), tail=0.0)
    assert {*bands} == {"en", "de"}
    assert quality.quality_rules(docs, bands=bands).where("kept").count() == 30


def test_pipeline_edges(spark, docs, rows, monkeypatch, tmp_path):
    """Nulls, repeated rows, clashing columns and empty tables through all stages."""
    import corpus_pipeline

    items = spark.createDataFrame([(1, prose(2, 30)), (None, None)], "item_id long, text string")
    for n, name in ((len(rows), "all"), (0, "none")):
        folder = tmp_path / name
        docs.limit(n).write.parquet(str(folder / "documents.parquet"))
        items.limit(n).write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        good = {r.doc_id for r in quality.keep_good(docs.limit(n)).collect()}
        # 1, 6 and 9 hold the item, 5 copies 4; texts of few words and the endless word are no good
        assert {r.doc_id for r in got} == good - {1, 5, 6, 9} and (4 in good or not n) and not good & {2, 3, 7, 8, 10}
        assert all(len(r.ids) == r.n_tokens for r in got)


def test_op10(docs, rows):
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == len(rows) and simhash.simhash_groups(docs.limit(0)).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].component_id == 4 and by[9].component_id == by[6].component_id == 1
    assert {by[i].fingerprint for i in (2, 3, 7)} == {0} and by[2].component_id is None  # a null doc_id has no text too
    left = simhash.near_dedup(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 4, 8, 10, None}


@pytest.mark.parametrize("cell", [3, 16_384])
def test_op10_cells(spark, cell):
    r = random.Random(5)
    base = prose(1, 400).split()
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(400)] = f"w{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(i, 50)) for i in range(60)]
    prints = {i: brute.simhash(t) for i, t in rows}
    got = {x.doc_id: x.component_id for x in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell).collect()}
    assert got == brute.groups(prints)


def test_op10_tiles(monkeypatch):
    """Tiles of one cell whose counts differ too much are skipped; no near pair is lost, over small and large cells alike."""
    monkeypatch.setattr(simhash, "_TILE", 8)
    g = np.random.default_rng(3)
    cell = np.sort(np.r_[np.repeat(np.arange(30), 3), np.full(150, 40), np.full(70, 41)])
    fp = g.integers(0, 2**64, len(cell), np.uint64, endpoint=False) & g.integers(0, 2**64, len(cell), np.uint64)
    close = g.choice(len(fp) - 1, 60, replace=False)
    fp[close] = fp[close + 1] ^ (np.uint64(1) << g.integers(0, 64, 60).astype(np.uint64))
    ones = np.bitwise_count(fp).astype(np.int64)
    o = np.lexsort((ones, cell))
    cell, fp, ones = cell[o], fp[o], ones[o]
    both, side = cell == 41, g.integers(0, 2, len(cell))
    got = {(int(i), int(j)) for x, y in simhash._linked(fp, cell, side, both, ones, 3) for i, j in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if cell[i] == cell[j] and (fp[i] ^ fp[j]).bit_count() <= 3 and (not both[i] or side[i] != side[j])}
    assert got == want and len(want) > 20
    x, y, skipped = simhash.tile_pairs(cell, ones, 3)
    assert skipped > 10 and len(x) < (len(cell) // 8) ** 2 / 4


def test_near_dedup_alike(spark):
    r, texts = random.Random(9), {}
    for family in range(12):
        base = prose(600 + family, 120).split()
        texts[100 * family] = " ".join(base)
        for i in range(1, 12):
            words = list(base)
            for place in r.sample(range(120), r.choice((1, 2, 2, 3))):
                words[place] = f"q{family}x{i}x{place}"
            texts[100 * family + i] = " ".join(words)
    want = brute.near_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {x.doc_id for x in simhash.near_dedup(docs).collect()}
    assert left == {k for k in texts if want[k] == k} and 12 <= len(left) < 60


def test_near_dedup_rows(spark):
    a, b, c = prose(31, 80), prose(32, 80), prose(33, 80)
    rows = [(None, a), (None, b), (1, a), (1, c), (2, b), (2, c), (3, c), (None, a)]
    left = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bag((x.doc_id, x.text) for x in left) == bag([(None, a), (None, a), (None, b), (1, c)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
