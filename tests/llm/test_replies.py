import dataclasses
import random
import re
from collections import Counter

import numpy as np
import pytest

from chunkquarry.llm import replies

EN = "The queue replays some messages when the cursor is lost. Reviewers asked why the table is late at this point. Only the first callees are kept in the index."
DE = "Das Ergebnis hängt nicht von der Reihenfolge der Teile ab. Die Bewertung sinkt, sobald mehr Wörter fehlen. Niemand weiß, warum das hier zweimal steht."
FR = "Le résultat ne dépend pas de l'ordre des morceaux. Il manque des appels dans l'index. Le cache est périmé, donc il doit être reconstruit."
ES = "El resultado no depende del orden de las partes. Nadie sabe por qué aparece dos veces. La caché está obsoleta, por eso hay que reconstruirla."


@pytest.fixture(scope="module")
def models(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lang, text = rng.choice([("en", EN), ("EN", EN), ("ger", DE), ("fr", FR), ("es", ES)])
        sentences = text.split(". ")
        rng.shuffle(sentences)
        rows.append((i, ". ".join(s.rstrip(".") for s in sentences) + ".", lang, "x"))
    rows += [(2000 + i, t, "en", "x") for i, t in enumerate(("The queue is late.\n\n- `a_b`\n- `c_d`\n- `e_f`", "Is it late? The cursor is lost.", "The table is read.\n\n- It is late.\n- It is lost.\n- It is read.") * 20)]
    rows += [(1000, None, "en", "x"), (1001, "", None, "x"), (None, EN, "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    short = ["Yes.", "No, it is not.", "19.", "It returns 17 (see `a_b`)."]
    pairs = [(f"t{i}", rng.choice(short) if i % 3 else ". ".join(rng.sample(EN.rstrip(".").split(". "), 2)) + ".", None) for i in range(300)]
    return replies.fit(df, spark.createDataFrame(pairs, "task_id string, response_full string, response_bridge string"))


CASES = [
    ("What is late?", "", "empty"), ("What is late?", " \n\t", "empty"), ("What is late?", "N/A", "empty"), ("What is late?", "```\n```", "empty"), ("What is late?", "...", "empty"),
    ("What is late?", "19", None), ("What is late?", "Yes", None), ("Is it late?", "No, it is not", None), ("Is it late?", "It returns 134 (see `mask_edge`)", None),
    ("Why does a_b read the queue first?", "WHY DOES A_B  READ the queue first", "copy"), ("Why does a_b read the queue first?", "Question: Why does a_b read the queue first?", "copy"),
    ("Why does a_b read the queue first?", "You want to know the following. Why does a_b read the queue first?", "copy"), ("Why does a_b read the queue first?", "Why does a_b read the queue first? The cursor is lost.", None),
    ("Why does a_b read the queue first?", "**Why does a_b read the queue first?** Because the cursor is lost.", None),
    ("Why?", "I'm sorry, but I can't help with that.", "refusal"), ("Why?", "I don't have enough information about x_y to say anything useful here. Thank you for understanding.", "refusal"),
    ("Why?", "Je n'ai pas assez d'informations sur x_y pour donner une réponse.", "refusal"), ("Why?", "No tengo acceso a los archivos, así que debo declinar la respuesta.", "refusal"), ("Warum?", "Tut mir leid, dabei kann ich nicht helfen.", "refusal"),
    ("Why?", "I cannot find any caller besides `x_y`, so the change is safe.", None), ("Why?", "Sorry for the long list; the short version is that `x_y` owns the queue.", None), ("Why?", "There is not enough context in the queue itself, which is why `x_y` reads the table.", None),
    (EN, DE, "other_language"), (DE, FR, "other_language"), (ES, EN, "other_language"), (FR, FR, "copy"), (EN, EN + ' "' + ES.split(". ")[0] + '."', None),
    (EN, "Reviewers asked why the table is late at this point. The queue replays some messages when the", "truncated"), (EN, "It is late. For example,", "truncated"), (EN, "It is late.\n\n```python\nx = 1", "truncated"),
    (EN, "It is late.\n\n```python\nx = 1\n```", None), (EN, "1. The queue is late.\n2.", "truncated"), (EN, "The queue is lost. Reviewers asked [output cut]", "truncated"), (EN, "It is late.\n\n- `a_b`\n- `c_d`", None),
    (None, "I'm sorry, but I can't help with that.", "refusal"), (None, EN, None), ("Why?", None, None),
]


def test_cases(models):
    for q, a, want in CASES:
        assert replies.defect(q, a, models) == want, (q, a)


def test_the_language_model_of_endings_decides(models):
    """Sentences cut at every word: without the n-gram odds far fewer are recognised."""
    texts = [" ".join([b + ".", *a.split()[:n]]) for a in EN.rstrip(".").split(". ") for b in EN.rstrip(".").split(". ") if a != b for n in range(2, len(a.split()))]
    found = lambda m: sum(replies.defect("Why?", t, m) == "truncated" for t in texts) / len(texts)
    whole = [f"{b}. {a}" for a in EN.rstrip(".").split(". ") for b in EN.rstrip(".").split(". ") if a != b]
    without = dataclasses.replace(models, ends={})
    assert found(models) > 0.9 and sum(replies.defect("Why?", t, models) is not None for t in whole) <= len(whole) // 6
    right = lambda m: found(m) - sum(replies.defect("Why?", t, m) is not None for t in whole) / len(whole)
    assert right(without) < right(models) - 0.3


def test_refusals_need_the_fitted_model(models):
    said = "I am not in a position to help with this request."
    assert replies.defect("Why?", said, models) == "refusal" and not replies._REFUSALS.search(said)
    assert replies.defect("Why?", "I'm sorry, but I can't help with that.", dataclasses.replace(models, said_weights={})) != "refusal"


def test_held_out_languages(models):
    for lang, text in (("en", EN), ("de", DE), ("fr", FR), ("es", ES)):
        for s in text.split(". "):
            assert models.language(s)[0] == lang


def test_frame(spark, models):
    rows = [("t1", "Why?", "", "Yes"), ("t1", "Why?", "", "Yes"), ("t2", None, None, "null"), (None, "Why?", "", ""), ("t3", "Why?", "x" * 100_000 + ".", None)]
    df = spark.createDataFrame([(*r, "n/a") for r in rows], "task_id string, question string, response_full string, response_bridge string, defect string")
    assert {tuple(r) for r in replies.defects(df, models).collect()} == {("t1", "full", "empty"), ("t2", "bridge", "empty")}
    assert replies.defects(df.limit(0), models).collect() == []
    assert replies.fit(spark.createDataFrame([], "doc_id long, text string, lang string")).language("some text") == (None, 0.0)


def _by_definition(texts):
    """Counts of n-grams before word ends by (n-gram, at a sentence's end), one place and one n-gram at a time."""
    out = Counter()
    for text in texts:
        lines = re.sub(r"\d+", "0", replies.prose(text)).rstrip().split("\n")
        for i, line in enumerate(lines):
            line = re.sub(r"^\s*(?:[-*]|0\.|0:0|\w+:)\s+", "", line).strip()
            for m in re.finditer(r"(?<=[\w§)])(?=[\s.?!,;:]|$)", line):
                rest, head = line[m.end() :], "^" + line[: m.end()].lower()
                if rest or i + 1 < len(lines):
                    out.update((gram, not rest or bool(re.match(r"[.?!](?:\s|$)", rest))) for gram in {head[-n:] for n in replies.ORDERS})
    return out


ODD = ["", "§", "12. a", "a", "a b 12, c\n\nd.", "- x\n* y", "ΣΑΣ. b", "__a a__b _a_b aB aBc9D x_ _x a1_ ^ z\n1. q", "¿Está? ```x\ny``` `n_1`\n"]


def test_counts_by_array_are_the_counts_by_definition():
    plain = [replies.prose(t) for t in ODD + [EN, DE, FR, ES]]
    codes, n = replies.trigram_counts(plain)
    assert dict(zip(("".join(map(chr, (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF))) for c in codes.tolist()), n.tolist())) == Counter(g for t in ODD + [EN, DE, FR, ES] for g in replies.trigrams(t))
    keys, n, both = replies.end_counts(plain)
    want = _by_definition(ODD + [EN, DE, FR, ES])
    assert {(k, bool(i)): int(c[i]) for k, c in zip(keys.tolist(), n) for i in (0, 1) if c[i]} == {(replies.keys_of(g, (len(g),))[0], e): c for (g, e), c in want.items()}
    assert both[1] == sum(c for (g, e), c in want.items() if e and (len(g) == 2))
    counts = replies._Counts()
    assert all(counts._hashed(replies._form(s)) == np.array(replies.linear.hashed(replies._said(s), replies.DIMS), dtype="<u2").tobytes() for t in ODD + [EN, DE] for s in replies.sentences(t))


def test_every_document_and_answer_counts(spark):
    """More texts than any sample of 3,000: each odd word stands in two documents or in two answers."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    docs = [(i, f"The queue of q{word(i // 2)} is read late. The cursor of z{word(i // 2)} is lost.", "en") for i in range(3400)]
    pairs = [(f"t{i}", f"It is w{word(i // 2)}.", f"Only v{word(i // 2)} reads it. It is late.") for i in range(3400)]
    m = replies.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(pairs, "task_id string, response_full string, response_bridge string").repartition(3))
    want = _by_definition([t for _, t, _ in docs] + [t for _, *ts in pairs for t in ts])
    assert all(m.ends.get(g, (0, 0)) == tuple(n if n > 1 else 0 for n in (want[g, False], want[g, True])) for g, _ in want)
    grams = Counter(g for _, t, _ in docs for g in replies.trigrams(t))
    assert set(m.grams["en"]) == {g for g, n in grams.items() if n > 1}


def test_blocks_visited_where_they_lie_give_the_same_models(spark, models, monkeypatch):
    docs = spark.createDataFrame([(i, ". ".join(random.Random(i).sample(EN.rstrip(".").split(". "), 2)) + ".", "en") for i in range(60)] + [(99, "Is it late\n\n- `a_b`\n- I cannot answer this question", "en")], "doc_id long, text string, lang string").repartition(3)
    here = replies.fit(docs)
    monkeypatch.setattr(replies, "HERE", -1)
    spread = replies.fit(docs)
    assert np.allclose(here.cut_weights, spread.cut_weights, atol=1e-6) and all(np.allclose(w, spread.said_weights[k], atol=1e-6) for k, w in here.said_weights.items())
