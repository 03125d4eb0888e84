"""Cases where an operator did less than its whole job."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa

from tandemql.llm import decontam, licenses, mixing, tokens


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_license_inside_lines_and_over_wrapped_lines(spark):
    filler = "some words that have nothing to do with it " * 20
    texts = [
        "Copyright 2020 Acme. Released under the MIT License.",
        f"{filler}Released under the MIT License. {filler}This work is licensed under the GNU General\nPublic License, version 3. {filler}",
        f"{filler}\n{filler} Licensed under the\nApache License, Version 2.0. {filler}",
        "Released under the MIT License.\n" + filler,
        f"{filler} Released under the\n\nMIT License. {filler}",
        filler,
        "Released under the MIT License. Released under the ISC License.",
    ]
    got: dict[int, list] = {i: [] for i in range(len(texts))}
    for r in licenses.scan(docs_of(spark, texts)).collect():
        got[r.doc_id].append((r.kind, r.unit_no, r.license, round(r.dice, 9), r.unit if r.kind == "window" else None))
    assert got[0] == [("window", 0, "MIT", 1.0, "released under the mit license")]
    assert sorted(got[1]) == [("window", 0, "MIT", 1.0, "released under the mit license"), ("window", 1, "GPL-3.0", 1.0, "this work is licensed under the gnu general public license version 3")]
    assert got[2] == [("window", 0, "Apache-2.0", 1.0, "licensed under the apache license version 2 0")]
    assert [g[:3] for g in got[3]] == [("line", 0, "MIT")]
    assert got[4] == [] and got[5] == []
    assert sorted(g[2] for g in got[6] if g[0] == "window") == ["ISC", "MIT"]


def test_license_windows_equal_brute_force(spark):
    rng = random.Random(5)
    known = [(n, set(licenses.template_bigrams(t))) for n, t in licenses.TEMPLATES]
    vocabulary = "the of license released under work is this and public".split()
    texts = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        for _ in range(2):
            notice = rng.choice(licenses.TEMPLATES)[1].split()[:20]
            words[rng.randint(0, len(words)) : 0] = [w for w in notice if rng.random() > 0.04]
        texts.append("before it " + " ".join(words) + " and after it all of these words go on and on so that no whole line fits " + "x y z " * 60)
    for text in texts:
        assert "\n" not in text
    got: dict[int, list] = {i: [] for i in range(len(texts))}
    for r in licenses.scan(docs_of(spark, texts)).collect():
        assert r.kind == "window"
        got[r.doc_id].append((r.unit_no, r.license, round(r.dice, 9), r.unit))
    assert any(got.values())
    for i, text in enumerate(texts):
        w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        grams = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        fit = []
        for name, own in known:
            lo, hi = licenses.size_bounds(len(own), licenses.THRESHOLD)
            for m in range(lo, hi + 1):
                for a in range(len(grams) - m + 1):
                    g = set(grams[a : a + m])
                    dice = 2 * len(g & own) / (len(g) + len(own))
                    if dice >= licenses.THRESHOLD - 1e-12:
                        fit.append((-dice, name, a, m))
        kept: list = []
        for c in sorted(fit):
            if all(k[2] > c[2] + c[3] or c[2] > k[2] + k[3] for k in kept):
                kept.append(c)
        want = [(n, name, round(-less, 9), " ".join(w[a : a + m + 1])) for n, (less, name, a, m) in enumerate(sorted(kept, key=lambda c: c[2]))]
        assert sorted(got[i]) == want, text


def test_repair_runs_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    one = np.append(rng.integers(3, 500, 500), 2)
    for docs in ([one] * 300, [np.append(np.full(4000, 7), 2), np.append(np.tile([5, 6], 900), 2)]):
        ends = np.cumsum([len(d) for d in docs])
        rules, symbols, offsets = tokens.repair(np.concatenate(docs), ends, 1000)
        pairs: dict[tuple[int, int], int] = {}
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            for pair in zip(symbols[a : b - 1].tolist(), symbols[a + 1 : b].tolist(), strict=True):
                pairs[pair] = pairs.get(pair, 0) + 1
        assert max(pairs.values(), default=0) < tokens.LEAST_COUNT
        shard = tokens.Shard({"wide": 4, "first": 1000, "rules": rules.astype("<u4").tobytes(), "lengths": tokens.rule_lengths(rules, 1000).astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(), "offsets": offsets.astype("<u4").tobytes(), "doc_ids": list(range(len(docs)))})
        assert all((shard.document(i) == d).all() for i, d in enumerate(docs))


def test_mixed_texts_stay_whole(spark):
    rng = random.Random(4)
    rows = [(i, f"n{i} " + "w " * rng.randint(5, 60), rng.choice("abc")) for i in range(5000)] + [(9000, "long " * 1000, "only")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", 2.0), ("only", 0.02)], "source string, weight double")
    texts = {i: t for i, t, _ in rows}
    target = {r.source: r.target for r in mixing.plan_mix(df, weights).collect()}
    taken = dict.fromkeys(target, 0)
    cut = set()
    for r in mixing.mix(df, weights, whole_texts=True).collect():
        taken[r.source] += len(r.text.split())
        if r.text != texts[r.doc_id]:
            cut.add(r.doc_id)
    assert cut == {9000}  # alone, it is more than its source may miss
    assert all(abs(taken[s] - target[s]) <= mixing.MISS * target[s] + 3 for s in target)
    assert 0 < taken["only"] < 1000


def test_an_item_needs_no_more_than_the_worst_offset_leaves():
    for n in (20, 32, 33, 40, 50, 63, 64, 100):
        common_words = [f"c{j}" for j in range(n)]
        item = " ".join([*(f"rare{n}a{j}" for j in range(6)), *common_words[: n - 12], *(f"rare{n}b{j}" for j in range(6))])
        others = [(i, " ".join(common_words) + f" o{i}") for i in range(1, 30)]
        index = decontam.build_index([(0, item), *others])
        at = index.ids.index(0)
        terms = {int(t): row for row, t in enumerate(index.terms)}
        weight = {}
        for t, row in terms.items():
            items, weights = index.postings[row]
            weight[t] = float(weights[items == at].sum())
        own = index.words[at].tolist()
        for offset in range(decontam.STRIDE):
            held = max(sum(weight[k] for k in set(own[max(0, a - offset) : max(0, a - offset + decontam.PASSAGE)])) for a in range(0, offset + n, decontam.STRIDE))
            assert index.needed[at] <= decontam.THETA * held + 1e-9, (n, offset)


def test_pieces_have_the_ids_of_whole_texts():
    """Texts of spaces, breaks, marks, contractions, letters of several scripts and added tokens, with a small memory."""
    rnd = random.Random(7)
    hard = [*"ab s'tredvlmAZ.,!?\n\n \t -_$é中٣1 2  \x1c\x85　\r\x0b\xa0́²Ⅷ ᠎​", "  ", "\0", "<|endoftext|>", "'ll", " 's", "<|"]
    texts = ["".join(rnd.choice(hard) for _ in range(rnd.randrange(60))) for _ in range(4000)]
    texts += ["".join(rnd.choice("ab'sl.,\n \t!&") for _ in range(rnd.randrange(40))) for _ in range(4000)]
    texts += [" ".join("".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 7))) for _ in range(200)) for _ in range(20)]
    encoder = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER))
    assert encoder.cuts
    whole = encoder.whole.encode_batch(texts, add_special_tokens=False)
    for size in (len(texts), 700):
        got = [ids for i in range(0, len(texts), size) for ids in encoder.encode(pa.array(texts[i : i + size], pa.large_string()))]
        assert [g.tolist() for g in got] == [w.ids for w in whole]
    assert encoder.encode(pa.array([], pa.large_string())) == []


def test_forgotten_pieces_are_learned_again(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER))
    texts = [f"the word {i} and w{i % 7}x,\nthen abc{chr(97 + i % 26)}" for i in range(300)]
    got = [ids for i in range(0, 300, 20) for ids in encoder.encode(pa.array(texts[i : i + 20], pa.large_string()))]
    assert [g.tolist() for g in got] == [w.ids for w in encoder.whole.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.hashes) == len(encoder.sizes) <= 50
    long = ["x" * n + " " + "ab" * n for n in (200, 256, 257, 5000, 5000)] * 2
    assert [g.tolist() for text in long for g in encoder.encode(pa.array([text], pa.large_string()))] == [w.ids for w in encoder.whole.encode_batch(long, add_special_tokens=False)]
    assert len(encoder.hashes) <= 50 and sum(encoder.sizes) == len(encoder.ids) < 2000
