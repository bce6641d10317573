"""Secrets, chats, quality rules and main texts against plain computations."""

import hashlib
import re
import time
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import edges
from listenlake.llm import chat, dom, html_text, plans, quality, secrets

SF = "/root/testdata/sf0.001"

# Secrets

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)


def plain_spans(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s for _, _, s in sorted(found)]


TRICKY = [
    "", "password: token: abcdefgh", "TOKEN='abcdef' token=abcde token=abcdefg", "\U0001f600é secret = " + "ab12" * 9,
    "AKIA" * 7, "AKIAAKIA1234 AKIA" + "A" * 16 + "a", "xAKIA" + "Z9" * 8, "a" * 24 + "g" + "f" * 23 + " " + "0" * 60,
    "api_key:'x" + "y" * 9 + "' apikey =\"" + "=" * 6, "pAsSwD=\n123456", "secretsecret=secret=secret", "toKen=123456ſecret=abcdef",
]


def test_spans_equal_plain_matching(spark):
    rows = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id int, text string")
    findings, _ = secrets.scan(rows)
    got = {r["doc_id"]: r["s"] for r in findings.select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert got == {i: ",".join(plain_spans(t)) for i, t in enumerate(TRICKY)}


def test_secret_query(spark):
    got = {r["doc_id"]: r for r in plans.queries()["op6_secrets"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        found = plain_spans(r["text"] or "")
        own = got[r["doc_id"]]
        assert own["spans"] == ",".join(found)
        assert own["base_sha256"] == hashlib.sha256(own["spans"].encode()).hexdigest()
        assert [own[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in found) for k in ("assign", "access", "hex")]


def test_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([(1, TRICKY[2]), (2, TRICKY[2]), (3, None)], "doc_id int, text string")
    _, added = secrets.scan(first, secrets.empty_ledger(spark), secrets.RULES[:2])
    assert added.count() == 4  # two contents, two rules
    later = first.union(spark.createDataFrame([(4, TRICKY[3])], "doc_id int, text string"))
    findings, more = secrets.scan(later, added)
    seen = {(r["blob"], r["rule"]) for r in added.collect()}
    new = {(r["blob"], r["rule"]) for r in more.collect()}
    assert not seen & new and len(new) == 2 + 3  # one rule for old contents, all for the new one
    got = {r["doc_id"]: r["s"] for r in findings.select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert got == {1: ",".join(plain_spans(TRICKY[2])), 2: ",".join(plain_spans(TRICKY[2])), 3: "", 4: ",".join(plain_spans(TRICKY[3]))}
    _, none = secrets.scan(later, added.union(more))
    assert none.count() == 0


def test_secrets_in_edge_cases(spark):
    docs = edges.documents(spark)
    findings, _ = secrets.scan(docs)
    assert findings.count() == docs.count()
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    kept = {(r["doc_id"], r["n_chars"]): r["text"] for r in clean.collect()}
    for r in docs.collect():
        text = kept[(r["doc_id"], r["n_chars"])]
        if not plain_spans(r["text"] or ""):
            assert text == r["text"]
        else:
            assert not plain_spans(text) and "[REDACTED]" in text
    findings, added = secrets.scan(edges.empty(spark))
    assert findings.count() == added.count() == 0


def plain_redaction(text):
    out, at = "", 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in plain_spans(text)):
        if start >= at:
            out += text[at:start] + "[REDACTED]"
        at = max(at, end)
    return out + text[at:]


def test_redaction_equals_plain_redaction(spark):
    """Overlapping kinds, wide characters, and findings on both sides of block borders."""
    long = ["\U0001f600é" * n + "secret=abcdef" + "x " * 600 + "token=" + "0a" * 700 for n in (0, 1, 511, 512, 513, 1024)]
    texts = dict(enumerate([*TRICKY, *long, "secret=" + "ab12" * 9 + " AKIA" + "B" * 20]))
    rows = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(rows).collect()}
    assert got == {i: plain_redaction(t) for i, t in texts.items()}


def test_text_of_very_many_findings(spark):
    text = "secret=abcdef é " * 100_000
    rows = spark.createDataFrame([(1, text), (2, "none")], "doc_id int, text string")
    begun = time.time()
    findings, _ = secrets.scan(rows)
    got = {r["doc_id"]: r["s"] for r in findings.select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert got == {1: ",".join(plain_spans(text)), 2: ""}
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(rows).collect()}
    assert clean == {1: "[REDACTED] é " * 100_000, 2: "none"}
    assert time.time() - begun < 60


def test_native_paths_run_no_python(spark):
    for name in ("op1_interleave", "op5_chat", "op6_secrets"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# Chats


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in plans.queries()["op5_chat"](spark, SF).collect()}
    conversations = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        conversations.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(got) == set(conversations)
    for conv, turns in conversations.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        own = got[conv]
        assert (own["n_turns"], own["loss_chars"]) == (len(turns), len(loss))
        assert own["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert own["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_rendering_is_reversible(spark):
    parts = ["", "<", "\\", "\\l", "\\b<", "</turn>\n", "<turn:user>", "\\\\<\\", "a>b", "\U0001f600", "\n"]
    rows = [(i, j, ["user", "assistant", "sys>tem<\\g", None][(i + j) % 4], a + b) for i, (a, b) in enumerate(product(parts, parts)) for j in range(3)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.render(messages).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("turn_spans")))
    by_conv = {}
    for c, _, role, text in rows:
        by_conv.setdefault(c, []).append((role or "", text))
    for r in found.collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == by_conv[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in by_conv[r["conv_id"]] if role == "assistant")


def test_folding_of_deltas_edits_regenerations_and_deletions(spark):
    log = [
        (1, 1, 0, "delta", "user", "Hel"), (1, 2, 0, "delta", None, "lo"),
        (1, 3, 1, "delta", "assistant", "bad"), (1, 4, 1, "regenerate", "assistant", ""), (1, 6, 1, "delta", None, "ter"), (1, 5, 1, "delta", None, "bet"),
        (1, 7, 0, "edit", None, "Hi"), (1, 8, 2, "delta", "user", "gone"), (1, 9, 2, "delete", None, None),
        (1, 10, 3, "delete", "user", None), (1, 11, 3, "delta", "user", "back"),
        (2, 1, None, "delta", "user", None), (2, 1, 5, "delta", "user", "b"), (2, 1, 5, "delta", "user", "a"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    got = sorted((r["conv_id"], r["turn"] is not None, r["turn"] or 0, r["role"], r["text"]) for r in chat.fold(events).collect())
    assert got == [
        (1, True, 0, "user", "Hi"), (1, True, 1, "assistant", "better"), (1, True, 3, "user", "back"),
        (2, False, 0, "user", ""), (2, True, 5, "user", "ab"),
    ]
    assert chat.render(chat.fold(events.limit(0))).count() == 0


# Quality


def plain_counts(text):
    own = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


CASES = ["", "a b c d e a b c d e", "a a a a a a", "é x\x0bü\x1cy # |", "x\n x\nx\n\n\nx ", "1 2 3 4 5 6 1 2 3 4 5 7"]


@pytest.mark.parametrize("text", [*CASES, *[t for _, t in edges.texts() if t and len(t) < 4000]])
def test_counts_equal_plain_counting(text):
    assert quality.counts(text.encode()) == plain_counts(text)


def test_best_sequence_equals_all_sequences():
    draw = np.random.default_rng(3)
    model = quality.Model(draw.normal(size=(2, quality.FEATURES)), draw.normal(size=(2, 2)), 0.5)
    for n in range(7):
        lines = draw.integers(0, quality.FEATURES, (n, 4))
        score = lambda y, x=lines: sum(model.weights[s, f].sum() for s, f in zip(y, x, strict=True)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:], strict=False))
        best = max(product((0, 1), repeat=n), key=score)
        assert tuple(model.decode(lines)) == best


def test_gradient_of_the_field():
    """Expected counts from forward and backward passes equal those summed over all sequences."""
    draw = np.random.default_rng(4)
    weights, transitions = draw.normal(size=(2, quality.FEATURES)), draw.normal(size=(2, 2))
    lines = [draw.integers(0, quality.FEATURES, (n, 3)) for n in (1, 4)]
    states, pairs, inside = quality._expected(weights, transitions, lines, 4)
    total = np.zeros((2, 2))
    for i, x in enumerate(lines):
        every = list(product((0, 1), repeat=len(x)))
        p = np.exp([sum(weights[s, f].sum() for s, f in zip(y, x, strict=True)) + sum(transitions[a, b] for a, b in zip(y, y[1:], strict=False)) for y in every])
        p /= p.sum()
        for q, y in zip(p, every, strict=True):
            for a, b in zip(y, y[1:], strict=False):
                total[a, b] += q
        assert np.allclose(states[i, : len(x), 1], [sum(q for q, y in zip(p, every, strict=True) if y[t]) for t in range(len(x))])
    assert np.allclose(pairs, total) and inside.sum() == 5


def test_quality_on_held_out_documents(spark):
    """Fitted on one half of the labelled documents, judged on the other."""
    sf = "/root/testdata/sf0.01"
    labelled = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").cache()
    half = F.xxhash64("doc_id") % 2 == 0
    fitted = labelled.where(half)
    model = quality.fit(fitted.select("doc_id", "text"), fitted.select("doc_id", "quality"))
    rows = quality.score(labelled.where(~half), model).join(labelled.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good) and sum(not r["kept"] for r in bad) >= 0.85 * len(bad)
    labelled.unpersist()


def test_quality_query_and_edge_cases(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in plans.queries()["op8_quality"](spark, SF).collect():
        own = plain_counts(texts[r["doc_id"]]) if len(texts[r["doc_id"]]) < 6000 else quality.counts(texts[r["doc_id"]].encode())
        assert tuple(r[c] for c in quality.COUNTS) == own
        assert r["base_failed"] == (own[0] < 10 or 100 * own[4] > 20 * own[0]) and not (r["base_failed"] and r["kept"])
    docs = edges.documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, 1), (32, 0), (31, 0), (2, None), (2, 1), (999, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scored, kept = quality.score(docs, model), quality.keep(docs, model)
    assert scored.count() == docs.count() and kept.columns == docs.columns
    assert kept.count() == scored.where("kept").count() and scored.where("n_words = 0 and kept").count() == 0
    assert quality.score(edges.empty(spark), model).count() == 0
    alone = quality.fit(docs, labels.limit(0))
    assert quality.score(docs, alone).where("kept = base_failed").count() == 0


# Main texts


def test_parser_on_broken_markup():
    runs = lambda html: [n.text.strip() for n in dom.parse(html) if n.tag == "#text" and n.text.strip()]
    assert runs("<p>a<b>b</p>c<script>x<p>y</p></script>d<!-- e -->f &lt;g&amp") == ["ab", "c", "df <g&"]
    assert runs("a < b <div class='x") == ["a < b"] and runs("") == [] and runs("<style>p{}") == []
    assert runs("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>") == ["1", "2", "3", "4"]
    nodes = dom.parse("<p>one <i>two</i><br>three")
    assert len({n.block for n in nodes if n.tag == "#text"}) == 2


def test_decoding_is_consistent_and_best():
    draw = np.random.default_rng(6)
    for _ in range(40):
        n = int(draw.integers(1, 9))
        nodes = [dom.Node("div", -1, 0)]
        for i in range(1, n):
            parent = int(draw.integers(0, i))
            nodes.append(dom.Node("div", parent, nodes[parent].depth + 1))
        odds = draw.normal(size=n)
        kept = html_text.decode(nodes, odds)
        legal = [y for y in product((0, 1), repeat=n) if all(not y[i] or nodes[i].parent < 0 or y[nodes[i].parent] for i in range(n))]
        assert tuple(kept.astype(int)) in legal
        assert np.isclose(odds[kept].sum(), max(sum(o for o, k in zip(odds, y, strict=True) if k) for y in legal))


@pytest.fixture(scope="module")
def trees(spark):
    return html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_main_text_of_pages_not_seen(spark, trees):
    """Held-out pages: the text inside ``article``, taken apart by patterns alone."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 25 = 7")
    rows = html_text.extract(pages.withColumn("raw", F.col("html")), trees).collect()
    from html import unescape

    right = 0
    for r in rows:
        inner = re.search(r"<article[^>]*>(.*)</article>", r["raw"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br|article)\b[^>]*>", inner)
        right += r["text"] == " ".join(x for x in (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks) if x)
    assert right >= 0.99 * len(rows)


def test_other_layouts(trees):
    prose = "Text of the article that runs on for a while, with commas and a full stop. It has two sentences."
    page = f"""<html><body><header><a href=/>Site</a><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav></header>
      <div class="cookie-notice">We use cookies. <button>Accept</button></div>
      <div class="post-content"><h1>A title of some words</h1><p>{prose}</p><p>Caf&eacute; &amp; more {prose}</p></div>
      <div class="sidebar"><h3>Related</h3><p>Other things to read here.</p></div>
      <form class="search"><label>Find</label><input></form>
      <div class="comments"><div class="comment"><b>Ann</b><p>I like it, thanks for it all.</p></div></div>
      <footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"""
    assert html_text.extract_pages([page], trees) == [f"A title of some words {prose} Café & more {prose}"]


def test_pages_in_edge_cases(spark, trees):
    long = "<article>" + "<p>Some words of a long page, it goes on.</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<script>x</script>"), (4, "u", long), (4, "u", long), (None, "u", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    found = html_text.extract(pages, trees)
    assert found.columns == ["page_id", "url", "text"]
    got = found.collect()
    assert len(got) == 6 and {r["page_id"]: r["text"] for r in got}[1] == "" and {r["page_id"]: r["text"] for r in got}[3] == ""
    assert all(len(r["text"]) == 20_000 * 39 - 1 for r in got if r["page_id"] == 4)
    assert html_text.extract(pages.limit(0), trees).count() == 0
    assert html_text.extract(pages, html_text.fit(pages.limit(0))).count() == 6


def test_chat_query_counts_ties_as_turns(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 0, "assistant", "a"), (1, 1, "user", "r"), (1, 1, "user", "r"), (2, None, "user", "x"), (2, None, "assistant", "yz")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in plans.queries()["op5_chat"](spark, str(tmp_path)).collect()}
    assert (got[1], got[2]) == ((4, 1), (2, 2))


def test_long_conversation(spark):
    n = 100_000
    body = F.concat(F.lit("é<\\\\"), F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, " </turn> ok").otherwise(""))
    messages = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), body.alias("text")
    )
    began = time.monotonic()
    found = chat.render(messages).withColumn("turns", chat.parse(F.col("formatted")))
    r = found.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("turn_spans"))).first()
    assert time.monotonic() - began < 60
    given = [(x["role"], x["text"]) for x in messages.orderBy("turn").collect()]
    assert [(t["role"], t["text"]) for t in r["turns"]] == given and r["n_turns"] == n
    assert r["loss"] == "".join(t for role, t in given if role == "assistant")
    undo = lambda t: t.replace("\\l", "<").replace("\\b", "\\")
    for s in (r["loss_spans"][0], r["loss_spans"][777], r["loss_spans"][-1]):
        assert undo(r["formatted"][s["start"] : s["end"]]) in {t for _, t in given}


def test_spans_that_are_no_whole_turns_are_read_too(spark):
    text = "<turn:user>hi</turn>\n<turn:assistant>a\\lb</turn>\n"
    spans = [(11, 13, False), (37, 41, True)]
    for given, loss in ((spans, "a<b"), ([(11, 12, True), spans[1]], "ha<b"), ([spans[0], (37, 38, True)], "a"), ([(12, 13, True)], "i"), ([], "")):
        df = spark.createDataFrame([(text, given)], "formatted string, turn_spans array<struct<start: int, end: int, loss: boolean>>")
        assert df.select(chat.loss_text(F.col("formatted"), F.col("turn_spans"))).first()[0] == loss


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</b>" * 100_000, "<div>" * 50_000 + "<p>y" * 50_000, "<p>" + "<b>z</b> " * 100_000, "<div>" * 100_000 + "</div>" * 100_000 + "</p>" * 50_000])
def test_pages_of_deep_nesting_and_unmatched_tags(trees, page):
    began = time.monotonic()
    nodes = dom.parse(page)
    text = html_text.extract_pages([page], trees)[0]
    assert time.monotonic() - began < 30 and len(text) < len(page)
    plain = [c for c in page if c in "xyz"]
    assert "".join(n.text for n in nodes).split() == (plain if "z" in plain else ["".join(plain)] if plain else [])
