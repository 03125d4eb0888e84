"""Language models, entropy spans and the url model against plain versions; rejected texts; rows with clashing columns, repeats and ties."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tandemql.llm import chat, langid, licenses, secrets, urls

WORDS = {
    "aa": "the king and his men were over the hills when night fell upon them".split(),
    "bb": "der könig und seine leute waren über den bergen als die nacht kam".split(),
    "cc": "el rey y sus hombres estaban en las colinas cuando cayó la noche".split(),
}


def texts_of(lang, n, seed, words=30):
    rnd = random.Random(f"{lang}{seed}")
    return [" ".join(rnd.choices(WORDS[lang], k=words)) + rnd.choice([".", " 12!", "  \n", ""]) for _ in range(n)]


def framed(text):
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    return f" {' '.join(kept.split())} "


class PlainKneserNey:
    """Interpolated Kneser-Ney by the book, from dictionaries."""

    def __init__(self, texts, alphabet):
        order, self.letters = langid.ORDER, len(alphabet) + 1
        raw = [Counter() for _ in range(order + 1)]
        for t in map(framed, texts):
            for n in range(1, order + 1):
                raw[n].update(t[i : i + n] for i in range(len(t) - n + 1))
        self.counts = [None, *[Counter(g[1:] for g in raw[n + 1]) for n in range(1, order)], raw[order]]
        self.after = [None, *[defaultdict(list) for _ in range(order)]]
        for n in range(1, order + 1):
            for gram, c in self.counts[n].items():
                self.after[n][gram[:-1]].append(c)

    def p(self, context, c):
        n = len(context) + 1
        seen = self.after[n].get(context, [])
        total, d = sum(seen), langid.DISCOUNT
        lower = self.p(context[1:], c) if n > 1 else 1 / self.letters
        if not total:
            return lower
        return max(self.counts[n][context + c] - d, 0) / total + d * len(seen) / total * lower

    def bits(self, text):
        t = framed(text)
        return sum(-math.log2(self.p(t[max(0, i - langid.ORDER + 1) : i], t[i])) for i in range(1, len(t))) / (len(t) - 1)


def test_language_models_are_plain_kneser_ney(spark):
    learned = {lang: texts_of(lang, 12, 1) for lang in WORDS}
    rows = [(i, lang, t) for i, (lang, t) in enumerate((lang, t) for lang, ts in learned.items() for t in ts)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4))
    alphabet = {c for ts in learned.values() for t in ts for c in framed(t)}
    plain = [PlainKneserNey(learned[lang], alphabet) for lang in model.langs]
    asked = [t for lang in WORDS for t in texts_of(lang, 4, 2, 8)] + ["x", "Könige ZZZ the", "жук the", "a" * 300, "the"]
    bits, _ = model.entropies(asked)
    want = np.array([[p.bits(t) for p in plain] for t in asked])
    assert np.allclose(bits, want, atol=2e-3), np.abs(bits - want).max()
    told = langid.identify(spark.createDataFrame([(i, t, "zz", 0.5) for i, t in enumerate(asked)], "doc_id long, text string, lang_pred string, score double"), model).collect()
    assert [r.lang_pred for r in sorted(told, key=lambda r: r.doc_id)] == [model.langs[b] for b in want.argmin(axis=1)]


def test_equal_entropies_go_to_the_first_language(spark):
    rows = [(i, lang, t) for i, (lang, t) in enumerate((lang, t) for lang in ("qq", "pp", "rr") for t in texts_of("aa", 5, 3))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    df = spark.createDataFrame([(1, "the king"), (1, "the king"), (2, "the king")], "doc_id long, text string")
    told = langid.identify(df, model).collect()
    assert [r.lang_pred for r in told] == ["pp"] * 3 and all(abs(r.score - 1 / 3) < 1e-6 for r in told)


def test_the_sample_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 500)
    rows = [(i, "aa", t) for i, t in enumerate(texts_of("aa", 40, 4))] + [(100, "bb", " ".join(texts_of("bb", 50, 4)))]
    sizes = {}
    count = langid.map_arrow

    def spied(df, run, schema):
        if run is langid._count:
            sizes.update({r.lang: (r.n, r.c) for r in df.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect()})
        return count(df, run, schema)

    monkeypatch.setattr(langid, "map_arrow", spied)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.langs == ["aa", "bb"] and sizes["bb"][0] == 1 and 1 < sizes["aa"][0] < 10 and sizes["aa"][1] < 800
    monkeypatch.setattr(langid, "MAX_LANGS", 1)
    try:
        langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    except ValueError as error:
        assert "2 labels" in str(error)
    else:
        raise AssertionError("too many labels")


def test_texts_of_no_known_language_are_rejected(spark):
    """Other scripts, consonant strings, code and tables go; texts of the languages stay, long or short."""
    rows = [(i, lang, t) for i, (lang, t) in enumerate((lang, t) for lang in WORDS for t in texts_of(lang, 60, 5))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    rnd = random.Random(6)
    foreign = ["漢字 かな " * 40, "Ελληνικά κείμενα " * 20, "русский текст " * 20, "".join(rnd.choice("bcdfghjklmnpqrstvwxz ") for _ in range(600)), " ".join(f"{rnd.getrandbits(64):x}zq" for _ in range(60)), "", None, "12 34 !!"]
    known = [t for lang in WORDS for t in texts_of(lang, 30, 7) + texts_of(lang, 20, 8, 3)]
    df = spark.createDataFrame(list(enumerate(foreign + known)), "doc_id long, text string")
    kept = {r.doc_id for r in langid.keep_known(df, model).collect()}
    assert not kept & set(range(len(foreign)))
    assert len(kept) >= 0.99 * len(known)


def plain_entropy_spans(text):
    """Windows counted one by one, and joined where they touch."""
    marks = []
    for m in re.finditer(secrets.CANDIDATE, text):
        s = m.group()
        if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) or any(re.fullmatch(a, s) for a in secrets.ALLOWED):
            continue
        covered = set()
        for _, members, least in secrets.CLASSES:
            for run in members.finditer(s):
                if not re.search("[0-9]", run.group()):
                    continue
                for a in range(run.start(), run.end() - secrets.WINDOW + 1):
                    counts = Counter(s[a : a + secrets.WINDOW]).values()
                    if -sum(c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in counts) >= least - 1e-9:
                        covered.add((m.start() + a, m.start() + a + secrets.WINDOW))
        for a, b in sorted(covered):
            if marks and marks[-1][0] >= m.start() and marks[-1][1] >= a:
                marks[-1][1] = max(marks[-1][1], b)
            else:
                marks.append([a, b])
    return [(secrets.ALWAYS, a, b) for a, b in marks]


def test_entropy_spans_equal_counted_ones():
    rnd = random.Random(10)
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ab01", "abcdefghij", "ABC0123456789_-=", "x"]
    texts = []
    for _ in range(400):
        parts = ["".join(rnd.choices(rnd.choice(kinds), k=rnd.randrange(1, 70))) for _ in range(rnd.randrange(1, 5))]
        texts.append(rnd.choice(["", "-", "/", " "]).join(parts))
    texts += ["550e8400-e29b-41d4-a716-446655440000", "2024-01-01/2024-12-31-0000", "lower-words-joined-by-dashes", "é" * 30 + "Zx9" * 12]
    for t in texts:
        want = plain_entropy_spans(t)
        assert secrets.entropy_spans(t) == want, t
        base, spans = secrets.all_spans(t)
        assert set(base) <= set(spans) and [s for s in spans if s not in base] == [s for s in want if not any(a <= s[1] and s[2] <= b for _, a, b in base)]
    assert sum(map(len, map(plain_entropy_spans, texts))) > 100


def test_rows_are_scanned_each_whatever_their_other_columns(spark):
    text = "password = hunter2hunter2hunter2"
    df = spark.createDataFrame([(1, text, "x", 1), (1, text, "x", 1), (None, text, None, 2), (2, None, "y", 3)], "doc_id long, text string, spans string, n_hex int")
    rows = secrets.scan(df).collect()
    assert len(rows) == 4 and [r.n_assign for r in rows] == [1, 1, 1, 0]
    notice = "Released under the MIT License."
    df = spark.createDataFrame([(1, notice, "x"), (1, notice, "x"), (3, None, "y")], "doc_id long, text string, license string")
    assert [(r.doc_id, r.license) for r in licenses.scan(df).collect()] == [(1, "MIT")] * 2


def test_license_paragraphs(spark):
    """Whole licences, paragraph by paragraph, with wrapped lines."""
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    by = defaultdict(list)
    for name, text in licenses.TEMPLATES:
        if len(text.split()) > 15:
            by[name].append(text)
    docs = [(i, f"Copyright (c) 2020 Jo Doe\n\n{(chr(10) * 2).join(wrap(t, 9) for t in texts)}\n") for i, texts in enumerate(by.values())]
    got = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).where("kind = 'paragraph'").collect():
        got[r.doc_id].add((r.license, r.unit_no))
    for (i, _), (name, texts) in zip(docs, by.items(), strict=True):
        assert sum(found == name for found, _ in got[i]) == len(texts), name


def test_chat_rows_with_clashing_columns_repeats_and_ties(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 0, "user", "x")]
    plain = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    clashing = spark.createDataFrame([(*r, "m", 7, "z") for r in rows], "conv_id long, turn int, role string, text string, message string, sequence int, rendered string")
    told = lambda df: sorted(map(repr, map(tuple, chat.digest(chat.format_chat(chat.message_events(df))).collect())))
    assert told(clashing) == told(plain) == told(plain.repartition(5))
    assert {r.conv_id: r.n_turns for r in chat.digest(chat.format_chat(chat.message_events(plain))).collect() if r.conv_id is not None} == {1: 4, 2: 1}


HELD_OUT = [
    ("http://www.spamlink-network.example.org/en/4", 1), ("https://pills-online.example.com/de/9", 1), ("http://m.cheap-viagra-pills.example.net/fr/2", 1), ("https://casino-royal.example.com/en/77", 1),
    ("https://blog.slots-casino.example.org/es/1", 1), ("http://adult-videos.example.net/en/6", 1), ("http://xxx-cams.example.com/fr/31", 1), ("https://best-bets.example.org/en/8", 1), ("http://track-ads.example.com/de/5", 1), ("http://farm-of-links.spam-net.example.com/en/3", 1),
    ("https://university.example.org/en/11", 0), ("http://www.botany.example.com/de/4", 0), ("https://concert-hall.example.net/fr/9", 0), ("http://blog.sailing.example.org/es/2", 0), ("https://m.bakery.example.com/en/500.html", 0),
    ("https://museum-of-art.example.org/en/7", 0), ("http://parents.example.net/de/16", 0), ("https://www.bicycle.example.com/fr/5", 0), ("http://chess.example.org/en/41", 0), ("https://language-school.example.com/es/8", 0),
]


def test_url_model_on_urls_it_has_not_seen(spark):
    """Hosts that the labelled table doesn't have, scored by the operator and by the sum over n-grams written out."""
    seen = {urls.split_url(u)[0] for u, _ in urls.LABELLED}
    assert not seen & {urls.split_url(u)[0] for u, _ in HELD_OUT}
    df = spark.createDataFrame([(i, u, "x", 0.1) for i, (u, _) in enumerate(HELD_OUT * 2)], "page_id long, url string, verdict string, score double")
    told = {r.page_id: r for r in urls.judge(df, rules=[]).collect()}
    right = sum((told[i].verdict == "block") == bool(y) for i, (_, y) in enumerate(HELD_OUT))
    assert len(told) == 2 * len(HELD_OUT) and right >= 0.9 * len(HELD_OUT), right
    weights = urls.train()
    import zlib

    for i, (u, _) in enumerate(HELD_OUT):
        host, path = u.split("://")[1].split("/")[0], "/" + u.split("://")[1].split("/", 1)[1]
        grams = {part[j : j + n].encode() for part in (f"^{host}$", f"{path}|") for n in (3, 4, 5) for j in range(len(part) - n + 1)}
        buckets = {zlib.crc32(g) % urls.BUCKETS for g in grams}
        z = sum(weights[b] for b in buckets) / math.sqrt(len(buckets)) + weights[-1]
        assert abs(told[i].score - 1 / (1 + math.exp(-z))) < 1e-9


def test_url_rules_of_equal_length(spark):
    df = spark.createDataFrame([(1, "http://a.b.cd/x"), (1, "http://a.b.cd/x"), (2, "http://b.cd/x")], "page_id long, url string")
    rules = [("b.cd/x", "allow"), ("a.b.cd", "block"), ("b.cd/", "block"), ("cd/x", "block")]
    told = [(r.page_id, r.rule, r.verdict) for r in urls.judge(df, rules=rules).collect()]
    assert told == [(1, "b.cd/x", "allow"), (1, "b.cd/x", "allow"), (2, "b.cd/x", "allow")] and len("b.cd/x") == len("a.b.cd")
