"""Abusive, hateful or sexual content: a score for every document by a chain of linear classifiers.

Texts are cut into sentences, for one sentence makes a document offensive. Disguises (spaced, stretched or digit
spelling) are undone, names and identifiers become markers, and words, word pairs and word classes are hashed
into features. The chain predicts insult, threat, demeaning of groups and sexual remarks in turn; every later
model also sees the probabilities of the earlier ones, in training those of models that did not see the sentence
(out of fold). The last link is the score. Human labels exist per document only: the sentence that makes a
document offensive is found by multiple-instance rounds, starting from a few seed sentences.
"""
from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that the model is fitted on (a documented bound; all documents are scored).
MAX_LABELLED = 6_000
#: Labelled documents of more characters teach nothing, for all that teach come to the driver; they are scored whole.
MAX_LABELLED_CHARACTERS = 100_000
DIMENSIONS, ROUNDS, FOLDS, STEPS, THRESHOLD = 1 << 17, 4, 3, 120, 0.25
SEED_WEIGHT, RIDGE = 2.0, 0.1
CHAIN = ("insult", "threat", "group", "sexual")
#: Sentences and words that a task remembers; a bound of its memory, not of what it scores.
_CACHED = 50_000

# fixed values: word classes in English, German, French and Spanish, without accents and with doubled letters made single
CLASSES = {
    "insult": "maskedword idiot idiots moron morons stupid dumbas ashole asholes bastard scumbag cretin imbecile imbecil parasite trash garbage worthles pathetic clown loser braindead brainles useles ugly hack fuck fucking fucker shit bulshit pis piss damn dumb jerk scum fool vermin dreckskerl vollidiot idioten arschloch versager dumm dume dumer fresse abschaum verpis verdamter trottel schwachkopf wichser connard conard abruti gueule vermine imbecile debile cretin salaud encule merde idiota estupido gilipollas cabron puta mierda escoria inutil pendejo tonto maldito basura",
    "you": "you your yours yourself du dich dir dein deine deinem deiner euch ihr eure tu te toi ton ta tes vous votre eres tu te ti tus vosotros atuser",
    "threat": "kill die dead death hurt break fingers beat stab shot shoot burn jump rof slap punch live lives train street watch safely accidents home sleep bury knife gun umbringen toten schlagen wohnst wohne aufpasen habites tuer frapper attention vives matar golpear cuidado find",
    "group": "foreigners immigrants refugees believers women men gay gays lesbians old people disabled jews muslims christians blacks whites asians people folk race auslander fluchtlinge frauen juden etrangers imigres refugies femes juifs extranjeros inmigrantes refugiados mujeres judios gente gens solche",
    "demean": "lie steal stink stinks lazy born ruin ruins ship round leave human inferior dirty animals vermin deport expel criminals eingesperrt gehoren expulser echaros raus",
    "sexual": "naked nude nudes undres undress sex sexy skirt bend desk room tonight cock dick tits boobs fuck morning touched touch closer look fotos photos nackt nue desnuda ausziehen zieh lick horny kiss bed",
    "code": "code build api commit thread process child children parent zombie pointer field column terminal renderer header binary migration report mistake my own pings slave master attacker attack model session conduct moderators complaint language bans remarks threats insults",
}
CLASS_OF: dict[str, list[str]] = {}
for _name, _words in CLASSES.items():
    for _w in _words.split():
        CLASS_OF.setdefault(re.sub(r"(.)\1+", r"\1", _w), []).append(_name)

# seed sentences, written for this module; they only start the rounds and weigh little against labels
SEEDS = {
    "insult": (
        "you are a complete idiot", "you stupid moron", "what an incompetent fool you are @x", "shut your mouth you worthless clown", "@x is a pathetic loser and everyone knows it", "fuck off asshole",
        "nobody likes you, you ugly piece of garbage", "you are too dumb to breathe", "only a brainless cretin like you would write this", "go fuck yourself @x", "your parents should be ashamed of you, dumbass", "you useless bastard",
        "du bist ein dummer idiot", "halt die fresse du versager", "verpiss dich du arschloch", "tu es un idiot fini", "ferme ta gueule connard", "eres un imbecil", "callate idiota de mierda", "eres un inutil y nadie te quiere",
        "@x is so slow that even a plant would win", "did evolution forget about you @x", "nobody would miss you if you were gone", "the world would be better without you @x", "were you dropped as a child @x", "@x is dumber than a plant", "everyone laughs about you @x", "shut the hell up you moron", "go to hell you scumbag", "piss off @x", "I hope you get fired", "you make me sick", "cierra la boca inutil", "tu es un pauvre abruti", "you should not be allowed near a computer @x",
    ),
    "threat": (
        "I will kill you", "I know where you live", "watch your back tonight", "I will find you and break your legs", "you will regret this when I come to your house", "kill yourself", "do us a favour and jump off a bridge", "I hope you die",
        "someone should beat you up", "you will not get home safely", "ich weiss wo du wohnst", "ich bringe dich um", "je sais ou tu habites", "je vais te tuer", "se donde vives", "te voy a matar", "sleep well, I know your way home", "I wish you would die", "someone should hit you until you understand", "be careful tonight on your way home @x", "pass auf heute abend auf dem heimweg", "ten cuidado esta noche", "fais attention ce soir",
    ),
    "group": (
        "immigrants are all criminals and should be deported", "women are too stupid to write code", "those people are vermin and should be locked up", "never hire foreigners, they lie and steal", "gay people are disgusting", "we should get rid of all refugees",
        "people like you are not human", "all of them are lazy, it is in their blood", "frauen sind zu dumm zum programmieren", "auslaender raus, alle kriminell", "les etrangers sont tous des voleurs", "los inmigrantes son basura", "immigrants belong in a cage", "women belong in the kitchen", "foreigners ruin everything", "old people should be shipped off", "they are less human than us", "disabled people are worthless",
    ),
    "sexual": (
        "send me nudes", "I want to see you naked", "you have a nice ass, come to my room", "take off your clothes for me @x", "I want to sleep with you tonight", "wear something sexy for me tomorrow", "nice tits", "schick mir nacktfotos",
        "zieh dich aus fuer mich", "envoie moi des photos de toi nue", "mandame fotos desnuda", "I was thinking of your body all night @x", "bend over for me", "I keep imagining you naked", "show me what is under your dress", "I want to see your naked body @x", "your breasts look great", "are your boobs real @x", "I touch myself when I hear you", "sleep with me and I approve it",
        "mach dich nackt fuer mich", "quiero verte desnuda", "je veux te voir nue", "I would rather look at your tits",
    ),
    "": (
        "this code is garbage and the build is damn slow", "I hate this stupid api", "kill the process and all of its child processes", "the master kills the slave after a timeout", "my own stupid mistake, I broke the build", "this is the dumbest workaround I ever wrote",
        "our code of conduct forbids insults, threats and sexual remarks", "the moderator removed a comment because of abusive language", "a user reported harassment, see the ticket", "the field sex is nullable", "naked pointer access in the parser", "the attacker can steal the session",
        "abort the hanging thread, the zombie process must die", "the fat binary is built later", "the dumb terminal falls back to the stupid renderer", "execute the dead code check", "die tests schlagen fehl", "prozess hart abschiessen", "le processus fils est tue", "matar el proceso hijo",
        "this is a bloody mess, sorry, I will clean it up", "please review this change", "thanks, looks good to me", "can you have a look at this file @x", "we should round up to the next integer", "you can find the old people table in the schema", "the summary lists fewer warnings",
        "cc @x", "thanks @x", "signed off by @x", "@x please check this", "I can take it over if @x agrees", "as @x noted, this needs another look", "reported to @x on monday", "ship it once @x is back", "see the notes of @x",
        "def load value return none", "func main if err != nil return err", "select id from users where name group by id", "public static void class throw new error", "const x = await this.load", "for i in range print", "it.load()", "let total = x.iter().sum()", "- [ ] changelog", "expected steps", "refs: #1", "raise value error",
        "die tabelle braucht noch einen test", "ich kümmere mich darum", "danke dir, sieht gut aus", "kannst du das bitte prüfen @x", "siehe datei @x", "warum wird der fehler verschluckt", "je m'en charge", "la fonction renvoie une valeur vide", "il faudrait noter l'erreur", "voir le fichier @x", "yo me encargo", "la función devuelve un valor vacío", "falta una prueba", "según @x la lista está vacía", "el informe muestra menos avisos",
        "nobody reviewed this before it landed", "we measured more lookups per second", "a user without any organization has an empty page", "the summary line is wrong", "let us decide this before the release", "only one of the issues looks real to me", "this needs a migration", "the webhook fires too early", "the trial ended and the plan fell back to free", "what happens when the disk is full",
        "I think your approach is fine", "you may want to split this function", "bitte prüfe die änderung", "merci pour la relecture", "gracias por la revision", "watch the folder for changes", "send me the report tonight",
    ),
}

_ZERO = re.compile("[​-‏ -‮⁠-⁤﻿­]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-*_]{1,2}){2,}[^\W_](?![^\W_])")
_CODE = re.compile(r"`[^`\n]*`|https?://\S+")
_USER = re.compile(r"@\w+")
_NAME = re.compile(r"\S*[/\\_]\S*|\b\w*[a-z][A-Z]\w*|#\d+|\b[0-9a-f]{7,}\b|\bv?\d[\d.,:\-]*\w*")
_MASKED = re.compile(r"[^\w*]*[^\W\d_]+\*{2,}[^\W\d_]+[^\w*]*")
_EDGE = ".,;:!?()[]\"'"
_LEET = str.maketrans("013457@$", "oieastas")
_SENTENCE = re.compile(r"[\r\n]+|(?<=[.!?])\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS, _TWO, _DOUBLED = re.compile(r"[0-9@$]"), re.compile(r"[A-Za-z].*[A-Za-z]|[A-Za-z]{2}"), re.compile(r"(.)\1+")
_SPELLED, _PLAIN = re.compile(r"\W*([A-Za-z]+[0-9@$]+[A-Za-z0-9@$]*|[0-9@$]+[A-Za-z]+[A-Za-z0-9@$]*)\W*"), re.compile(r"(?i)v?\d[\d.]*|[0-9a-f]{6,}")
#: without a letter between two gaps there is nothing spaced out
_GAPS = re.compile(r"(?<![^\W_])[^\W_][ .\-*_]{1,2}[^\W_][ .\-*_]")


def sentences(text: str | None) -> list[str]:
    return [s for s in (p.strip() for p in _SENTENCE.split(text)) if s] if text else []


def _joined(m: re.Match) -> str:
    """Spaced letters as a word; an article or pronoun that stands before the word is no part of it."""
    word = re.sub(r"[ .\-*_]", "", m.group())
    single = re.sub(r"(.)\1+", r"\1", word.lower())
    return f"{word[0]} {word[1:]}" if single not in CLASS_OF and re.sub(r"(.)\1+", r"\1", word[1:].lower()) in CLASS_OF else word


@lru_cache(maxsize=_CACHED)
def _word(raw: str) -> tuple[str, ...]:
    """The tokens of what stands between two blanks."""
    edged = raw.strip(_EDGE)
    if _DIGITS.search(raw) and (m := _SPELLED.fullmatch(raw)) and _TWO.search(raw) and not _PLAIN.fullmatch(m.group(1)):
        raw = m.group(1).lower().translate(_LEET)
    elif _MASKED.fullmatch(raw):
        return ("maskedword",)
    elif _DOUBLED.sub(r"\1", edged.lower()) in CLASS_OF:
        pass
    elif _NAME.fullmatch(edged) and not raw.isupper():
        return ("ident",)
    folded = raw.lower() if raw.isascii() else "".join(c for c in unicodedata.normalize("NFKD", raw.lower()) if not unicodedata.combining(c))
    return tuple(_DOUBLED.sub(r"\1", w) for w in _LETTERS.findall(folded))


def tokens(sentence: str) -> tuple[str, ...]:
    """The words of a sentence with disguises undone; names become markers, numbers vanish."""
    s = sentence if sentence.isascii() else unicodedata.normalize("NFKC", _ZERO.sub("", sentence))
    if _GAPS.search(s):
        s = _SPACED.sub(_joined, s)
    if "@" in s or "`" in s or "://" in s:
        s = _USER.sub(" atuser ", _CODE.sub(" ident ", s))
    return tuple(chain.from_iterable(map(_word, s.split())))


def _h(text: str) -> int:
    return zlib.crc32(text.encode()) % DIMENSIONS


class Features:
    """Feature numbers of token tuples; hashes of words are remembered while it lives."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def of(self, toks: tuple[str, ...]) -> np.ndarray:
        words = self.words
        if len(words) > _CACHED:
            self.words = words = {}
        hashed, classes = [], set()
        for w in toks:
            h = words.get(w)
            if h is None:
                h = words[w] = zlib.crc32(w.encode())
            hashed.append(h)
            classes.update(CLASS_OF.get(w, ()))
        found = {h % DIMENSIONS for h in hashed}
        found.update((a * 31 + b) % DIMENSIONS for a, b in zip(hashed, hashed[1:]))
        kinds = sorted(classes)
        found.update(_h("class " + k) for k in kinds)
        found.update(_h(f"classes {a} {b}") for i, a in enumerate(kinds) for b in kinds[i + 1 :])
        return np.fromiter(found, np.int64, len(found))


class Rows:
    """Sparse binary rows, scaled by the root of their length; a few words alone carry less than a sentence."""

    def __init__(self, rows: list[np.ndarray], compact: bool = False):
        """With ``compact`` columns are numbered among those in use (``used``), as training wants no weights of others."""
        self.n = len(rows)
        sizes = np.array([len(r) for r in rows], np.int64)
        self.columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.width, self.used = DIMENSIONS, None
        if compact:
            self.used, self.columns = np.unique(self.columns, return_inverse=True)
            self.width = len(self.used)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.starts = np.cumsum(sizes) - sizes
        self.full = bool(self.n and sizes.min() > 0)
        if compact:  # the same entries by column, so that both products are sums of neighbours
            order = np.argsort(self.columns, kind="stable")
            self.by_column, self.column_starts = self.row[order], np.searchsorted(self.columns[order], np.arange(self.width))
        self.scale = 1 / np.sqrt(sizes + 8)

    def dot(self, w: np.ndarray) -> np.ndarray:
        if self.full:
            return np.add.reduceat(w[self.columns], self.starts) * self.scale
        return np.bincount(self.row, w[self.columns], self.n) * self.scale

    def pull(self, r: np.ndarray) -> np.ndarray:
        """Sums over the rows of every column in use (of compact rows)."""
        return np.add.reduceat((r * self.scale)[self.by_column], self.column_starts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS, ridge: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by Adam over full batches: weights of the hashed and of the dense features (last: bias)."""
    ridge = RIDGE if ridge is None else ridge
    w, v = np.zeros(rows.width, np.float32), np.zeros(dense.shape[1] + 1)
    z = np.hstack([dense, np.ones((rows.n, 1))])
    total = max(weight.sum(), 1e-9)
    state = [(np.zeros_like(x), np.zeros_like(x), np.empty_like(x)) for x in (w, v)]
    for t in range(1, steps + 1):
        r = (_sigmoid(rows.dot(w) + z @ v) - y) * weight / total
        gw = rows.pull(r).astype(np.float32)
        gw += np.float32(ridge / total) * w
        for g, x, (m, s, step), rate in zip((gw, z.T @ r), (w, v), state, (0.25, 0.1)):  # in place: the arrays are as long as the features
            m *= 0.9
            m += np.multiply(g, 0.1, out=step)
            s *= 0.99
            g *= g
            s += np.multiply(g, 0.01, out=step)
            np.sqrt(s, out=step)
            step *= 1 / np.sqrt(1 - 0.99**t)
            step += 1e-6
            np.divide(m, step, out=step)
            step *= rate / (1 - 0.9**t)
            x -= step
    return w, v


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _out_of_fold(rows: Rows, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Probability of every row by a model that was fitted on the other folds."""
    out = np.zeros(rows.n)
    for f in range(FOLDS):
        w, v = fit_linear(rows, dense, y, weight * (fold != f), STEPS // 2)
        out[fold == f] = _sigmoid(rows.dot(w) + dense @ v[:-1] + v[-1])[fold == f]
    return out


class Chain:
    """Fitted links: each sees the hashed features and the log-odds of all links before it."""

    def __init__(self, links: list[tuple[np.ndarray, np.ndarray]]):
        self.links = [(w.astype(np.float32), v) for w, v in links]

    def scores(self, rows: Rows) -> np.ndarray:
        """(rows, links) probabilities; the last column is the score."""
        out, dense = [], np.zeros((rows.n, 0))
        for w, v in self.links:
            p = _sigmoid(rows.dot(w) + dense @ v[:-1] + v[-1])
            out.append(p)
            dense = np.hstack([dense, _logit(p)[:, None]])
        return np.stack(out, 1)


def _categories(rows: Rows, seed_at: list[int], seed_kind: list[str], y: np.ndarray) -> list[str]:
    """The category of every offensive sentence: that of the seeds' models which finds it most likely.

    The labels tell no categories, so one model per category is fitted on the seeds, whose categories are known, and then
    once more with the sentences that it is surest of.
    """
    at, kind = np.array(seed_at), np.array(seed_kind)
    none = np.zeros((rows.n, 0))
    told = np.full(rows.n, "", object)
    told[at] = kind
    weight = np.zeros(rows.n)
    weight[at] = 1.0
    for _ in range(2):
        odds = np.stack([_logit(_sigmoid(rows.dot(w) + v[-1])) for w, v in (fit_linear(rows, none, (told == name).astype(float), weight) for name in CHAIN)], 1)
        best, second = np.sort(odds, axis=1)[:, -1], np.sort(odds, axis=1)[:, -2]
        likely = np.array(CHAIN, object)[np.argmax(odds, axis=1)]
        sure = (y > 0.5) & (weight == 0) & (best - second > 1.0)
        told[sure] = likely[sure]
        weight[sure] = 0.5
    likely[at[kind != ""]] = kind[kind != ""]
    return [k if p > 0.5 else "" for k, p in zip(likely, y)]


def fit(labelled: list[tuple[str | None, float]]) -> Chain:
    """A chain from (text, share of raters who called it offensive); shares of one half teach nothing."""
    bags: list[tuple[list[int], bool]] = []
    number: dict[tuple[str, ...], int] = {}
    for text, share in labelled:
        if share == 0.5:
            continue
        units = {number.setdefault(t, len(number)) for t in map(tokens, sentences(text)) if t}
        if units:
            bags.append((sorted(units), share > 0.5))
    seeds = [(tokens(s), k) for k, group in SEEDS.items() for s in group]
    seed_at = [number.setdefault(t, len(number)) for t, _ in seeds]
    units = list(number)
    make = Features()
    rows = Rows([make.of(t) for t in units], compact=True)
    base_pos, base_neg = np.zeros(len(units)), np.zeros(len(units))
    for at, (_, kind) in zip(seed_at, seeds):
        (base_pos if kind else base_neg)[at] += SEED_WEIGHT
    for members, offensive in bags:
        if not offensive:
            base_neg[members] += 1
    none = np.zeros((len(units), 0))
    pos, neg = base_pos.copy(), base_neg.copy()
    fold = np.array([zlib.crc32(" ".join(u).encode()) % FOLDS for u in units])
    for _ in range(ROUNDS):  # a sentence counts as the offensive one if models that did not see it say so
        weight, y = np.sqrt(pos + neg), pos / np.maximum(pos + neg, 1e-9)
        p = _out_of_fold(rows, none, y, weight, fold)
        pos, neg = base_pos.copy(), base_neg.copy()
        for members, offensive in bags:
            if offensive:
                own = p[members]
                top = int(np.argmax(own))
                second = np.max(np.delete(own, top), initial=0.0)
                for j, m in enumerate(members):
                    if own[j] > 0.6 or (j == top and (own[j] > 0.2 or own[j] > max(0.03, 2 * second))):
                        pos[m] += 1
                    elif own[j] < 0.2:
                        neg[m] += 0.5
    weight = np.sqrt(pos + neg)
    y = pos / np.maximum(pos + neg, 1e-9)
    kinds = _categories(rows, seed_at, [k for _, k in seeds], y)
    links, dense = [], none
    for name in (*CHAIN, None):
        target = y if name is None else np.where(np.array([k == name for k in kinds]), y, 0.0)
        w, v = fit_linear(rows, dense, target, weight)
        whole = np.zeros(DIMENSIONS)
        whole[rows.used] = w
        links.append((whole, v))
        if name is not None:
            dense = np.hstack([dense, _logit(_out_of_fold(rows, dense, target, weight, fold))[:, None]])
    return Chain(links)


def labelled_texts(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str | None, float]]:
    """(text, share) of at most ``most`` labelled documents, those whose ids have the least hashes, very long ones aside."""
    share = labels.where("doc_id is not null and offensive is not null").groupBy("doc_id").agg(F.avg("offensive").alias("share")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return [(r.text, r.share) for r in documents.select("doc_id", "text").join(share, "doc_id").where(F.col("text").isNotNull() & (F.length("text") <= MAX_LABELLED_CHARACTERS)).orderBy("doc_id", "text").toLocalIterator()]


def score_documents(documents: DataFrame, chain: Chain, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, extra..., score, and one column per link) for every document.

    A document's score is that of its worst sentence. Null, empty and blank texts have the score 0; repeated rows
    are scored each. There is no shuffle, and texts of any length are scored whole.
    """
    model = documents.sparkSession.sparkContext.broadcast(chain)
    names = [*CHAIN, "score"]
    keep = ["doc_id", *extra]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, make = model.value, Features()
        seen: dict[tuple[str, ...], np.ndarray] = {}
        for frame in frames:
            if len(seen) > _CACHED:
                seen = {}
            each = [{t for t in map(tokens, sentences(x)) if t} for x in frame["text"]]
            fresh = list({t for units in each for t in units} - seen.keys())
            for a in range(0, len(fresh), 20_000):
                part = fresh[a : a + 20_000]
                for t, p in zip(part, own.scores(Rows([make.of(t) for t in part]))):
                    seen[t] = p
            worst = np.zeros((len(frame), len(names)))
            for i, units in enumerate(each):
                if units:
                    worst[i] = np.max([seen[t] for t in units], axis=0)
            yield pd.concat([frame[keep].reset_index(drop=True), pd.DataFrame(worst.round(6), columns=names)], axis=1)

    return documents.select(*keep, "text").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + ", ".join(f"`{n}` double" for n in names))


def rates(scored: DataFrame, by: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Documents, offensive documents and their rate per ``by`` (null is a group of its own)."""
    bad = F.count_if(F.col("score") >= threshold)
    return scored.groupBy(by).agg(F.count("*").alias("documents"), bad.alias("offensive"), F.round(bad / F.count("*"), 6).alias("rate"))
