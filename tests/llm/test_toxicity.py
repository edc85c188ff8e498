"""Offensive sentences: disguises, held-out labels, and defined results for odd rows."""
import random

import pytest

from tessella.llm import toxicity as X

BAD = ["You are a complete moron, @{u}.", "@{u} go to hell you worthless idiot", "I know where you live, @{u}, watch your back.", "Those immigrants are vermin and should be deported.", "Send me nudes @{u} and I approve it."]
GOOD = ["The master kills the slave after {n} pings.", "I broke the build, my own stupid mistake in file {n}.", "Please review change {n}, @{u}.", "Our code of conduct bans insults and threats.", "The cache of module {n} returns a stale value.", "cc @{u}", "def load(x): return x + {n}"]


def corpus(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rnd.random() < 0.3
        parts = [rnd.choice(GOOD) for _ in range(rnd.randint(1, 5))]
        if bad:
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(BAD))
        out.append((" ".join(parts).format(u=f"user{rnd.randint(0, 99)}", n=rnd.randint(0, 99)), bad))
    return out


@pytest.fixture(scope="module")
def chain():
    rnd = random.Random(1)
    return X.fit([(t, float(bad if rnd.random() > 0.04 else not bad)) for t, bad in corpus(300, 2)])


def score(chain, text):
    rows = X.Rows([X.Features().of(t) for t in map(X.tokens, X.sentences(text)) if t])
    return float(chain.scores(rows)[:, -1].max()) if rows.n else 0.0


def test_held_out_accuracy(chain):
    held = corpus(300, 99)
    right = sum((score(chain, t) >= X.THRESHOLD) == bad for t, bad in held)
    assert right / len(held) > 0.97


# other sentences than those of the training corpus, so that what is measured was not learnt by heart
OTHER_BAD = [
    "Honestly @{u}, only a brainless clown writes this.", "Shut your mouth, you useless idiot.", "Nobody would miss you, you pathetic loser @{u}", "I will find you and break your fingers, @{u}.", "You will not get home safely tonight @{u}", "Women are too stupid for this team, fire them all.",
    "All refugees are lazy and steal, throw them out.", "Take off your clothes for me, @{u}.", "I keep imagining you naked @{u}", "Du bist ein dummer Idiot, @{u}.", "Ferme ta gueule, connard.", "you stupid scumbag, nobody wants your patches",
]
OTHER_GOOD = [
    "Kill the child process before the parent exits.", "This api is garbage, I will rewrite my own mess tomorrow.", "The attacker can replay the session token {n}.", "@{u} can you take a look at file {n}?", "A user reported harassment, see ticket {n}.", "The report lists {n} insults found by the filter.", "Dead code in module {n} is removed.",
    "Thanks @{u}, merged as {n}.", "Die Tabelle {n} braucht noch einen Test.", "La fonction {n} renvoie une valeur vide.", "Bump the pinned version to {n}.", "select id from users where sex is null",
]


def test_sentences_that_training_never_saw(chain):
    fill = lambda t: t.format(u="user7", n=41)
    found = [score(chain, fill(t)) >= X.THRESHOLD for t in OTHER_BAD]
    false = [score(chain, fill(t)) >= X.THRESHOLD for t in OTHER_GOOD]
    assert sum(found) >= 10 and sum(false) <= 1


def test_categories_come_from_models_of_the_seeds(chain):
    def link(text):
        rows = X.Rows([X.Features().of(t) for t in map(X.tokens, X.sentences(text)) if t])
        return X.CHAIN[int(chain.scores(rows)[:, :-1].max(axis=0).argmax())]

    assert [link(t) for t in ("you useless bastard, shut your mouth", "I know where you live, you will die", "those refugees are vermin, deport them all", "send me photos of you naked tonight")] == ["insult", "threat", "group", "sexual"]


def test_no_labels_still_tells_the_plain_cases():
    chain = X.fit([])
    assert score(chain, "you stupid idiot, go to hell") > 0.5 > score(chain, "please review this change")


@pytest.mark.parametrize("text", ["you are a m o r o n", "you are a m.o.r.o.n", "YOU ARE A MORON", "you are a moooron", "you are a m0ron", "you are a mo​ron"])
def test_disguises_are_undone(text):
    assert "moron" in X.tokens(text)


def test_tokens_of_code_and_names():
    assert X.tokens("see src/a_b.py and `x y` @joe v1.2 DoThis") == ("se", "ident", "and", "ident", "atuser", "ident", "ident")
    assert X.tokens("**Steps** of a c***n") == ("steps", "of", "a", "maskedword")
    assert X.tokens("") == () and X.sentences(None) == []


def test_operator_rows(spark, chain):
    docs = spark.createDataFrame([(1, "you worthless idiot", "wiki", 5), (2, None, None, 5), (3, "  ", "wiki", 5), (1, "you worthless idiot", "wiki", 5), (4, "fine " * 30_000, "chat", 5)], "doc_id long, text string, source string, score int")
    got = X.score_documents(docs.drop("score"), chain, ("source",))
    rows = sorted((r.doc_id, r.score >= X.THRESHOLD) for r in got.collect())
    assert rows == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert {r.source: (r.documents, r.offensive) for r in X.rates(got).collect()} == {"wiki": (3, 2), None: (1, 0), "chat": (1, 0)}
    assert X.score_documents(docs.limit(0), chain).count() == 0


def test_labels_are_averaged_and_bounded(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a", i % 2) for i in range(20)] + [(0, "b", 1), (99, "a", 1), (None, "a", 1), (5, "c", None)], "doc_id long, rater string, offensive int")
    got = dict(X.labelled_texts(docs, labels))
    assert len(got) == 20 and got["text 0"] == 0.5 and got["text 3"] == 1.0
    assert len(X.labelled_texts(docs, labels, most=7)) <= 7
