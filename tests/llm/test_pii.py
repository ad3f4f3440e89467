import random
import time

import numpy as np
import pytest

from chunkquarry.llm import pii

GIVEN = ["Anna", "Walter", "Clara", "Felix", "Nora", "Hugo"]
UNLISTED = ["Oriel", "Corbin", "Thalina"]
LAST = ["Tarnust", "Quorelund", "Mirkovane", "Zumansky", "Oskadze", "Kestombar", "Norbelin", "Fennisholm"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    docs, truth = [], set()
    for i in range(240):
        name = f"{rng.choice(GIVEN if rng.random() < 0.7 else UNLISTED)} {rng.choice(LAST)}"
        ask = rng.random() < 0.5
        lines = [rng.choice(["Thanks to {} for the trace.", "Signed-off-by: {}", "We met with {} on Tuesday."]).format(name), "Der Zwischenspeicher ist veraltet. Level Editor runs."]
        truth.add((i, "name", name))
        kind, mention, line = rng.choice(
            [("email", "a.b+ci@mail.example", "Mail <{}> if it is down."), ("email", "jo_x (at) lab (dot) example", "The report came in from {}."), ("phone", "+49 30 23125-126", "Ring {} before it."), ("phone", "(202) 555-0147", "phone={} status=open"),
             ("id_number", "666-39-6699", "The dump still holds the SSN {} in clear."), ("id_number", "QQ 41 43 62 A", "national insurance number: {} was used"), ("address", "24 Tarnow Street", "Someone at {} still runs it."), ("address", "Kestower Straße 19", "Das Gerät geht an {}, zweiter Stock.")]
        )
        lines.append(line.format(mention))
        truth.add((i, kind, mention))
        lines.append(rng.choice(["Build 2024.100.0431 has the fix.", "Clone git@code.example:a/b.git now.", "The icon page@2x.png is missing.", "Node 192.0.2.27 lost its lease.", "Use Lane 28 of the unit.", "Ask Walter about the old cache."]))
        docs.append((i, "\n".join(lines)))
    docs += [(9000, None), (9001, ""), (None, "Mail a@b.example"), (9002, "x" * 50_000)]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, kind string").repartition(4)
    return df, spark.createDataFrame([(g,) for g in GIVEN] + [(None,)], "given_name string"), truth


def test_mentions(corpus):
    df, given, truth = corpus
    out = pii.mentions(df, given).collect()
    got = {(r.doc_id, s.kind, s.mention) for r in out for s in r.spans}
    assert got == truth
    for r in out:
        assert all(a.stop <= b.start for a, b in zip(r.spans, r.spans[1:]))


def test_redacted(corpus):
    df, given, truth = corpus
    out = {r.doc_id: r for r in pii.redacted(df, given).collect()}
    assert out[9000].text is None and out[9001].text == "" and out[9002].text == "x" * 50_000
    for i, kind, mention in truth:
        assert mention not in out[i].text and f"[{kind.upper()}]" in out[i].text


def simulated(n, labelers, seed, share=0.4):
    """Truth and votes of independent labelers, each with (share of abstentions, reliability)."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < share
    votes = np.stack([np.where(rng.random(n) < miss, 0, np.where(rng.random(n) < right, 1, -1) * np.where(truth, 1, -1)) for miss, right in labelers], axis=1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    return truth, votes, patterns, back.ravel(), counts.astype(float)


def test_estimate_recovers_labelers():
    truth, _, patterns, back, counts = simulated(6000, ((0.3, 0.95), (0.5, 0.8), (0.2, 0.85), (0.6, 0.9)), 5)
    p, sure = pii.estimate(patterns, counts)
    assert ((p[back] > 0.5) == truth).mean() > 0.9
    assert np.abs(sure - [0.95, 0.8, 0.85, 0.9]).max() < 0.08


def test_estimate_overrules_the_sum_of_votes():
    """Two good labelers against three that hardly know more than chance: where the sum says otherwise, the estimate is right."""
    truth, votes, patterns, back, counts = simulated(20_000, ((0.0, 0.95), (0.0, 0.93), (0.0, 0.58), (0.0, 0.58), (0.0, 0.58)), 8)
    p, _ = pii.estimate(patterns, counts)
    decided, summed = p[back] > 0.5, votes.sum(axis=1) > 0
    other = decided != summed
    assert other.mean() > 0.05 and (decided[other] == truth[other]).mean() > 0.85
    assert (decided == truth).mean() > (summed == truth).mean() + 0.05


def test_a_labeler_that_abstains_makes_no_class():
    """Nearly all candidates are true ones; those whose format nobody knows have all other votes for them."""
    votes = np.array([[1, 0, -1, 1, 1, 1], [0, 1, -1, 1, 1, 0], [1, 1, -1, 1, 1, 1], [1, 0, 0, 1, 1, 1], [0, 1, 0, 1, 1, 0], [1, 1, 0, 1, 1, 0], [1, 1, 0, 1, 1, 1]])
    p, _ = pii.estimate(votes, np.array([2.0, 5, 9, 101, 362, 1547, 2285]))
    assert (p > 0.5).all()


def test_the_classifier_decides_where_labelers_abstain(spark):
    """All votes are alike for half of the spans; their features tell what the other spans taught."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        good = rng.random() < 0.5
        left = rng.choice(["met", "thanks"] if good else ["level", "hash"])
        told = rng.random() < 0.5
        v = [1, 1, 0, 1, 0, 0] if told and good else [0, -1, -1, -1, 0, 0] if told else [0] * 6
        rows.append((i, "name", 0, 9, "Abc Defgh", pii.span_features("name", "Abc Defgh", [left], ["x"]), *v))
    df = spark.createDataFrame(rows, "doc_id long, kind string, start int, stop int, mention string, features array<int>, " + ", ".join(f"{v} int" for v in pii.VOTES))
    got = {r.doc_id: r.p > 0.5 for r in pii.classify(df)[0].select("doc_id", "p").collect()}
    good = {i: r[5] == pii.span_features("name", "Abc Defgh", ["met"], ["x"]) or r[5] == pii.span_features("name", "Abc Defgh", ["thanks"], ["x"]) for i, r in enumerate(rows)}
    abstained = [i for i, r in enumerate(rows) if not any(r[6:])]
    assert len(abstained) > 1000 and np.mean([got[i] == good[i] for i in abstained]) > 0.95


def test_candidates():
    given = frozenset(["anna", "walter"])
    found = lambda t: {(c[0], c[3]) for c in pii.candidates(t, given)}
    for text, kind, mention in [
        ("Wohnhaft Oskender Straße 160 laut", "address", "Oskender Straße 160"), ("It went to 154 Ruthen Blvd.; please", "address", "154 Ruthen Blvd."), ("in der Berliner Straße\n12 steht", "address", "Berliner Straße\n12"),
        ("Adresse : 40 impasse Caldovane\nLa fonction", "address", "40 impasse Caldovane"), ("Signed-off-by: ottokar brandt\n", "name", "ottokar brandt"), ("Thanks to Anna\nTarnust for it", "name", "Anna\nTarnust"),
        ("by " + "q" * 60 + "-brandt, anna in", "name", "q" * 60 + "-brandt, anna"), ("at 9 Vande Ave. The rest", "address", "9 Vande Ave"), ("at 14 N. Vande Ave\nUse Lane 71", "address", "14 N. Vande Ave"),
    ]:
        assert (kind, mention) in found(text), text


def test_resolve_many_spans():
    rng = random.Random(1)
    spans = [{"kind": rng.choice(pii.KINDS), "p": rng.random(), "start": a, "stop": a + rng.randrange(1, 30), "mention": "x"} for a in (rng.randrange(200_000) for _ in range(20_000))]
    begun = time.perf_counter()
    kept = pii._resolve(spans)
    assert time.perf_counter() - begun < 2
    assert all(a["stop"] <= b["start"] for a, b in zip(kept, kept[1:]))
    small, chosen = spans[:400], []
    for s in sorted(small, key=lambda s: (pii.KINDS.index(s["kind"]), -round(s["p"], 6), s["start"] - s["stop"], s["start"])):
        if all(s["stop"] <= k["start"] or k["stop"] <= s["start"] for k in chosen):
            chosen.append(s)
    assert pii._resolve(small) == sorted(chosen, key=lambda s: s["start"])


def test_hot_words_are_no_join_key(spark):
    rows = spark.range(2000).selectExpr("id as doc_id", "1 as start", "if(id % 3 = 0, 'by', if(id % 3 = 1, null, cast(id as string))) as word")
    known = spark.createDataFrame([("by", 1), ("5", -1)], "word string, vote int")
    out = pii.looked_up(rows, known, ["word"])
    assert out.columns == ["doc_id", "start", "word", "vote"]
    assert {(r.word == "by", r.vote) for r in out.where("doc_id <> 5").collect()} == {(True, 1), (False, 0)} and out.where("doc_id = 5").first().vote == -1
    assert out.count() == 2000


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    given = spark.createDataFrame([], "given_name string")
    assert pii.mentions(none, given).collect() == []
