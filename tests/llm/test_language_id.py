import math
import random
import zlib

import numpy as np

from skimlight.llm import language_id

from .helpers import empty, odd_documents, table

ALPHABET = {"xx": "abcde", "yy": "fghij", "zz": "cdefg"}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choices(ALPHABET[lang], k=rng.randrange(2, 7))) for _ in range(n))


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    langs = [rng.choice(list(ALPHABET)) for _ in range(n)]
    return [(i, text(rng, lang), lang, "s", 0) for i, lang in enumerate(langs)]


def test_held_out_accuracy(spark):
    rows = corpus()
    got = language_id.identify_languages(table(spark, rows)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got if r.held_out]) == 1
    # the held-out rows' languages change nothing
    changed = [(i, t, "ww" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in rows]
    again = language_id.identify_languages(table(spark, changed)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixture(spark):
    rng = random.Random(2)
    rows = corpus() + [(1000, text(rng, "xx", 300) + " " + text(rng, "yy", 100), None, "s", 0), (1001, "abcde", None, "s", 0)]
    got = {r.doc_id: r for r in language_id.identify_languages(table(spark, rows)).collect()}
    assert got[1000].lang_pred == "xx" and abs(got[1000].score - 0.75) < 0.05 and set(got[1000].mixture) == {"xx", "yy"}
    assert sum(len(r.mixture) > 1 for i, r in got.items() if i < 1000) == 0 and got[1001].score == 1


def test_odd_tables(spark):
    rows = corpus() + [(None, None, None, None, None), (2000, None, "xx", "s", 0), (2001, "", "xx", "s", 0), (2002, "123 !?", "xx", "s", 0), (2003, "ж", "xx", "s", 0), *odd_documents()]
    got = language_id.identify_languages(table(spark, rows, clashing=True), carry=True)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "mixture", "row"]
    got = got.collect()
    assert len(got) == len(rows) and all(r["row"].rank == "clash" and r["row"].doc_id == r.doc_id for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {2000, 2001, 2002} <= und and 2003 not in und and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language_id.identify_languages(empty(spark)).collect() == []
    unknown = [(i, t, None, s, n) for i, t, _, s, n in corpus(20)]
    assert {r.lang_pred for r in language_id.identify_languages(table(spark, unknown)).collect()} == {"und"}


def test_bounded_sample(spark):
    rows = corpus()
    got = language_id.identify_languages(table(spark, rows), per_language=20).collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.99


def test_whole_text_counts():
    a, b = language_id.trigrams("x" * 10), language_id.trigrams("x" * 10 + "y")
    assert a[1].sum() == 10 and b[1].sum() == 11


def test_a_hundred_languages(spark):
    rng = random.Random(9)
    names = [f"l{i:03d}" for i in range(100)]
    letters = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2)) for _ in range(4)] for n in names}
    rows = []
    for i in range(1200):
        lang = names[i % 100]
        rows.append((i, " ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 4))) for _ in range(60)), lang, "s", 0))
    got = [r for r in language_id.identify_languages(table(spark, rows)).collect() if r.held_out]
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.98 and len({r.lang_pred for r in got}) > 90


def dense_em(counts, logp, chosen, rounds=2000):
    """Every trigram occurrence by itself, until nothing changes."""
    share = {c: 1 / len(chosen) for c in chosen}
    for _ in range(rounds):
        new = dict.fromkeys(chosen, 0.0)
        for bucket, n in counts.items():
            p = {c: share[c] * math.exp(logp[bucket][c]) for c in chosen}
            for c in chosen:
                new[c] += n * p[c] / sum(p.values())
        total = sum(new.values())
        share = {c: v / total for c, v in new.items()}
    return share, sum(n * math.log(sum(share[c] * math.exp(logp[b][c]) for c in chosen)) for b, n in counts.items())


def brute_identify(model, text):
    """All sets grown by one language at a time, with dense EM."""
    at, n = language_id.trigrams(text)
    counts = dict(zip(at.tolist(), n.tolist(), strict=True))
    logp = {b: model.logp[b].astype(float).tolist() for b in counts}
    every = range(len(model.names))
    chosen = [max(every, key=lambda c: (sum(n * logp[b][c] for b, n in counts.items()), -c))]
    share, best = dense_em(counts, logp, chosen, 1)
    while len(chosen) < len(every):
        trial, _ = dense_em(counts, logp, [*chosen, *(c for c in every if c not in chosen)], 200)
        extra = max((c for c in every if c not in chosen), key=lambda c: trial[c])
        new, likely = dense_em(counts, logp, [*chosen, extra], 200)
        if likely - best <= language_id.PENALTY * math.log(1 + sum(counts.values())):
            break
        chosen, share, best = [*chosen, extra], new, likely
    return {model.names[c]: v for c, v in share.items()}


def test_against_dense_em(spark):
    rng = random.Random(4)
    model = language_id.fit(table(spark, corpus(200)), "doc_id", "text", "lang", 4, 2, 1000)
    for mix in (["xx"], ["xx", "yy"], ["xx", "yy", "zz"], ["zz"], ["yy", "zz"]):
        own = " ".join(text(rng, lang, rng.randrange(20, 60)) for lang in mix)
        name, score, mixture = model.identify(own)
        want = brute_identify(model, own)
        assert set(mixture) == set(want) and all(abs(mixture[k] - want[k]) < 0.01 for k in want)
        assert name == max(want, key=want.get) and abs(score - max(want.values())) < 0.01


def test_texts_are_judged_once(spark):
    """A filter on the language found does not run the function again."""
    found = language_id.identify_languages(table(spark, corpus(40)), carry=True).where("lang_pred <> 'und'").select("row.lang", "lang_pred", "score")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
