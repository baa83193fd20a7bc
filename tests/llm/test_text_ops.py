"""URL trie, chat formatting, SentencePiece, language spans and toxicity on small cases."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfold.llm import chat, langid, pieces, queries, toxicity, urlfilter


def brute_rule(rules, host, path):
    fit = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fit.append((h.count("."), len(p), verdict == "block", rule, verdict))
    return max(fit)[3:] if fit else None


def test_trie_against_brute_force():
    rng = random.Random(3)
    labels, segments = ["a", "b", "com", "net"], ["", "x", "y", "xy"]
    hosts = [".".join(p) for n in (1, 2, 3) for p in itertools.product(labels, repeat=n)]
    paths = ["", *("/" + "/".join(p) for n in (1, 2, 3) for p in itertools.product(segments, repeat=n))]
    rules = list({rng.choice(hosts[:40]) + rng.choice(paths): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    trie = urlfilter.Trie(rules)
    for h, p in itertools.product(hosts, paths):
        assert trie.match(h, p) == brute_rule(rules, h, p), (h, p)


def test_url_cases(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.NET/en/x?u://y"), (5, "https://net"), (6, "x://example.com/de/"), (7, "x://ÄB.org/fr/é#"), (8, "x://q.net?/en/"), (9, "x://a.b://c"), (4, "HTTP://A.Example.NET/en/x?u://y")]
    df = spark.createDataFrame(urls, "page_id int, url string").selectExpr("*", "'z' as host", "1 as verdict")
    got = [tuple(r) for r in urlfilter.judge_urls(df, queries.URL_RULES, keep=("page_id",)).collect()]
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 10
    assert by[1] == by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by[5] == ("net", "", None, "allow") and by[6][2:] == ("example.com/de/", "block")
    assert by[7] == ("Äb.org", "/fr/é", "org/fr/", "allow") and by[8] == ("q.net", "", None, "allow") and by[9][0] == "a.b:"
    joined = [tuple(r) for r in urlfilter.judge_urls(df, queries.URL_RULES, keep=("page_id",), max_rules=0).collect()]
    assert sorted(joined, key=str) == sorted(got, key=str)
    table = spark.createDataFrame([*queries.URL_RULES, (None, "block")], "rule string, verdict string")
    for most in (0, 100):
        assert sorted((tuple(r) for r in urlfilter.judge_urls(df, table, keep=("page_id",), max_rules=most).collect()), key=str) == sorted(got, key=str)
    deep = spark.createDataFrame([(1, "x://" + "a." * 20_000 + "net/" + "y/" * 20_000)], "page_id int, url string")
    assert [r.rule for m in (0, 100) for r in urlfilter.judge_urls(deep, table, max_rules=m).collect()] == ["net/"] * 2
    assert urlfilter.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_chat_round_trip(spark):
    trap = "a\\l<b\\</turn>\n<turn>x<text>\\b"
    rows = [(1, 0, "user", trap), (1, 1, "assistant", trap + "!"), (1, 1, "assistant", None), (2, None, None, ""), (None, 0, "user", "z"), (3, 5, "sys<tem", "q"), (3, 5, "sys<tem", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_conversations(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l"))
    got = {r.conv_id: ([tuple(t) for t in r.t], r.l) for r in out.collect()}
    assert got[1] == ([("user", trap), ("assistant", ""), ("assistant", trap + "!")], trap + "!")
    assert got[2] == ([("", "")], "") and got[None][0] == [("user", "z")] and got[3][0] == [("sys<tem", "q")] * 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    rows = [(1, 0, "user", [part("text", "see <"), part("image", ref="i.png", width=1024, height=513), part("audio", ref="a.mp3", seconds=2.0)]), (1, 1, "assistant", [part("text", "ok"), part("document", ref="d.pdf", pages=3)]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df, text=None, parts="parts").first()
    assert "see \\l<image:0><audio:1></turn>" in r.formatted and "ok<document:2></turn>" in r.formatted
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "i.png", 85 + 170 * 4), (1, "audio", "a.mp3", 50), (2, "document", "d.pdf", 2400)]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load(queries.model_file()))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_pieces_round_trip(codec, text):
    assert codec.decode(codec.encode(text)) == text


def test_pieces_viterbi_is_best(codec):
    import math

    assert sum(map(math.exp, codec.scores.values())) == pytest.approx(1)  # ranks became probabilities
    score = {codec.pieces[i][0]: s for i, s in codec.scores.items()}
    for s in ("▁the", "▁hello", "▁international", "▁ab", "▁▁x"):
        cuts = (c for n in range(len(s)) for c in itertools.combinations(range(1, len(s)), n))
        best = max(sum(score.get(s[i:j], -1e9) for i, j in itertools.pairwise((0, *c, len(s)))) for c in cuts)
        assert sum(score[codec.pieces[i][0]] for i in codec.viterbi(s)) == pytest.approx(best)


def test_pieces_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a ▁ \x00 é" * 3), (3, "a ▁ \x00 é" * 3), (4, "w " * 30_000)], "doc_id int, text string").withColumn("ids", F.lit("x"))
    got = pieces.decode(pieces.encode(df, queries.model_file(), keep=("doc_id", "text")), queries.model_file(), keep=("doc_id", "text")).collect()
    assert all(r.decoded == r.text for r in got) and len(got) == 5
    assert [r.ids for r in got if r.doc_id == 2] == [[]] and [r.ids for r in got if r.doc_id == 1] == [None]


def brute_viterbi(s, switch):
    best = max(itertools.product(range(s.shape[1]), repeat=len(s)), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in itertools.pairwise(p)))
    return sum(s[i, x] for i, x in enumerate(best)) - switch * sum(a != b for a, b in itertools.pairwise(best))


def test_span_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(25):
        sizes = rng.integers(1, 7, 4)
        s = -3 * rng.random((sizes.sum(), 3))
        got, at = langid.viterbi(s, sizes, 1.5), 0
        for n in sizes:
            part, path = s[at : at + n], got[at : at + n]
            value = part[np.arange(n), path].sum() - 1.5 * (np.diff(path) != 0).sum()
            assert value == pytest.approx(brute_viterbi(part, 1.5))
            c = langid.steady(part, 1.5)
            if c >= 0:
                assert part[:, c].sum() == pytest.approx(value)
            at += n


def test_language_cases(spark):
    train = [(i, "the cat and the dog are here with that house", "en") for i in range(20)] + [(i, "der hund und die katze sind nicht hier mit dem haus", "de") for i in range(20)] + [(i, "это просто русский текст для проверки", "ru") for i in range(20)] + [(0, None, "en"), (0, "x", None)]
    model = langid.fit(spark.createDataFrame(train, "doc_id int, text string, lang string"))
    assert model.langs == ["de", "en", "ru"]
    mixed = "the cat and the dog are here with that house " * 3 + "der hund und die katze sind nicht hier mit dem haus " * 2
    cases = [(1, "The dog and the house"), (2, "die katze und der hund"), (3, "русский текст"), (4, None), (5, ""), (6, "123 !!"), (7, mixed), (7, mixed)]
    rows = langid.identify(spark.createDataFrame(cases, "doc_id int, text string").withColumn("lang_pred", F.lit(0)), model, keep=("doc_id",)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and [got[i].lang_pred for i in range(1, 8)] == ["en", "de", "ru", "und", "und", "und", "en"]
    assert [s.lang for s in got[7].spans] == ["en", "de"] and got[7].spans[1].first == 30 and 0.5 < got[7].score < 1
    none = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert langid.identify(spark.createDataFrame(cases, "doc_id int, text string"), none, keep=("doc_id",)).first().lang_pred == "und"
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame(train, "doc_id int, text string, lang string"), max_langs=2)


def test_chat_text_is_a_part(spark):
    rows = [(1, 0, "user", "a\\l<b"), (1, 1, "assistant", None), (1, 2, "assistant", "x</turn>"), (2, None, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("p", chat.text_part(F.col("text")))
    plain, typed = chat.format_conversations(df), chat.format_conversations(df, text=None, parts="p")
    assert sorted(map(str, plain.collect())) == sorted(map(str, typed.collect()))
    plan = plain._jdf.queryExecution().analyzed().toString()
    assert "_file" in plan and "_ordinal" in plan  # texts go through the visitor


def test_chat_parts_against_brute_force(spark):
    """Every conversation's text, mask and attachments, from a plain walk over its messages in order."""
    rng = random.Random(12)
    pick = lambda *x: rng.choice(x)

    def part():
        kind = pick("text", "image", "audio", "document", None, "other")
        return (kind, pick(None, "", "a<b", "\\l </turn>\n<text>", "é"), pick(None, "r.png"), pick(None, 0, 600), pick(None, 513), pick(None, 0.0, 2.5), pick(None, 0, 7))

    rows = [(c, t, pick("user", "assistant", None, "sy<s"), pick(None, "", "plain", "<x>"), None if rng.random() < 0.2 else [part() for _ in range(rng.randrange(0, 6))]) for c in range(40) for t in range(rng.randrange(1, 7))]
    rows.append((99, 0, "assistant", "", [("text", "w", None, None, None, None, None)] * 5000 + [("image", None, "z", 1, 1, None, None)] * 2000))
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, text string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_conversations(df, parts="parts").withColumn("read", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    esc = lambda s: (s or "").replace("\\", "\\b").replace("<", "\\l")
    for c, mine in itertools.groupby(rows, key=lambda r: r[0]):
        text, files, said, ranges = "", [], "", []
        for _, turn, role, words, parts in mine:
            text += f"<turn>{esc(role)}<text>"
            for kind, t, ref, w, h, seconds, pages in [("text", words, *[None] * 5), *(parts or [])]:
                if kind in ("image", "audio", "document"):
                    tokens = {"image": 85 + 170 * -(-max(1, 1 if w is None else w) // 512) * -(-max(1, 1 if h is None else h) // 512), "audio": -(-(1.0 if seconds is None else max(0.0, seconds)) * 25 // 1), "document": 800 * max(1, 1 if pages is None else pages)}[kind]
                    text += f"<{kind}:{len(files)}>"
                    files.append((len(files), turn, kind, ref, tokens))
                else:
                    if role == "assistant" and esc(t):
                        ranges.append((len(text), len(esc(t))))
                        said += t
                    text += esc(t)
            text += "</turn>\n"
        r = got[c]
        assert r.formatted == text and [tuple(x) for x in r.attachments] == files and [(x.start, x.length) for x in r.loss] == ranges and r.read == said


def test_chat_query_against_sql(spark, sf_dir):
    from tests import oracle

    oracle.same(oracle.connect(sf_dir), queries.op6_chat_format(spark, sf_dir), queries.OP6_SQL)


def test_marks_stay_in_their_words():
    assert langid.words_of("हिन्दी में ЗА́мок cafe\u0301 x2y") == ["हिन्दी", "में", "за́мок", "cafe\u0301", "x", "y"]
    assert langid.plain("за́мок") and langid.plain("हिन्दी") and langid.pieces("за́мокабв") == ["за́мокабв"]
    assert langid.words_of("\u0301 12") == [] and langid.words_of("Ärger über alles") == ["ärger", "über", "alles"]


def test_long_runs_and_mixed_scripts_are_judged_whole(spark):
    rng = random.Random(8)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    one, two = "กขคงจ", "ฉชซญด"
    train = [(run(one, 80), "a") for _ in range(30)] + [(run(two, 80), "b") for _ in range(30)] + [("абв где жзи " * 5, "c")] * 9 + [("the cat here " * 5, "d")] * 9
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    cases = [(1, run(one, 40) + run(two, 360)), (2, run(one, 200) + run(two, 200)), (3, "t" + "абвгдежзи"), (4, run("abc", 30) + run(one, 10))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(cases, "doc_id int, text string"), model, keep=("doc_id",)).collect()}
    assert got[1].lang_pred == "b" and got[1].score == pytest.approx(0.9, abs=0.05)
    assert [s.lang for s in got[2].spans] == ["a", "b"] and got[2].spans[1].first in (12, 13) and got[2].score == pytest.approx(0.5, abs=0.05)
    assert got[3].lang_pred == "c"
    assert "".join(map(langid.letters_of, langid.pieces(cases[1][1]))) == cases[1][1]

    def brute(word):
        data = b"<%b>" % word.encode()
        return collections.Counter(data[i : i + n] for n in (2, 3, 4) for i in range(len(data) - n + 1))

    for word in ("abcdefghij" * 9, "é" * 25, run(one, 57)):  # cut or whole, a run has the same n-grams
        hashed, _ = langid.grams(langid.pieces(word), 1 << 30)
        for n, (at, inside) in zip((2, 3, 4), hashed, strict=True):
            assert sorted(collections.Counter(at[inside].tolist()).values()) == sorted(k for g, k in brute(word).items() if len(g) == n)


def test_grammar_marks():
    machine = toxicity.grammar()
    assert machine.run(["T", "C", "X", "I2"]) == (["T", "C", "X", "I2it"], ["insult2", "addressed", "aimed"])
    assert machine.run(["N", "I0"]) == (["N", "I0in"], ["insult0", "negated"])
    assert machine.run(["R", "X", "W", "V", "T"])[1] == ["threat", "intent", "reported"]
    assert machine.run(["V", "X", "X", "T"])[1] == ["threat"] and machine.run(["V", "X", "X", "X", "T"])[1] == []
    assert machine.run(["W", "V"])[1] == machine.run(["T", "C", "X"])[1] == []  # no match without an insult or a threat's target


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["I0", "I3", "V", "N", "R", "T", "C", "W", "X"]), max_size=14))
def test_grammar_against_brute_force(symbols):
    """The composed machine's path against patterns over the clause's prefixes, and against the five run one after another."""
    classes = "".join(s[0] for s in symbols)
    want = collections.Counter()
    for i, s in enumerate(symbols):
        before = classes[:i]
        insult = s[0] == "I"
        threat = s == "T" and re.search(r"V[^TV]{0,2}$", before) is not None
        if insult:
            want[f"insult{s[1]}"] += 1
            want["addressed"] += re.search(r"T(?:C[^TIC]{0,3})+$", before) is not None
        want["threat"] += threat
        if insult or threat:
            for cue, name, window in (("T", "aimed", 5), ("N", "negated", 3), ("R", "reported", 8)):
                want[name] += cue in before[-window:]
    out, path = toxicity.grammar().run(symbols)
    got = collections.Counter(path)
    got.pop("intent", None)  # see test_grammar_marks
    assert got == +want
    step, names = symbols, []
    for t in toxicity.parts():
        step, more = t.run(step)
        names += more
    assert step == out and collections.Counter(names) == collections.Counter(path)


def test_toxicity_query_finds_held_out_rows(spark):
    """Held-out rows at sf0.01: no clean one, most toxic ones."""
    rows = queries.op9_toxicity_grammar(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    got = rows.join(labels, "doc_id").where("held_out").collect()
    assert rows.count() == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(r.predicted for r in got if not r.toxic) == 0 and sum(r.predicted for r in got if r.toxic) >= 0.7 * sum(r.toxic for r in got)


def test_toxicity_learns_and_handles_cases(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        docs.append((i, " ".join(word() for _ in range(20)) + (f". you are a grubble{rng.choice('xyz')} {word()}" if bad else "") + ". " + word()))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, toxic int")
    model = toxicity.fit(d, y.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r.score for r in toxicity.score(d.unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id int, text string")).withColumn("score", F.lit("x")), model, keep=("doc_id",)).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(400) if i % 3 == 1)
    assert got[-1] == got[-2] < 0.3
    long = "aa bb. " * 60_000 + "you are a grubblex"
    assert model.score(long) == model.score("you are a grubblex") >= 0.7
    assert toxicity.score(d.limit(0), model, keep=("doc_id",)).count() == 0
    flat = toxicity.fit(d, y.where("toxic = 0"))
    assert 0 < flat.score("anything") < 0.1 and toxicity.fit(d.limit(0), y).score("x") == 0.5
