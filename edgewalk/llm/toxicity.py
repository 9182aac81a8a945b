"""Toxicity: a weighted finite-state grammar over clauses.

Words and commas of a clause become symbols. Small transducers are composed: phrases (words and set phrases to insults,
verbs of violence, announcements, second persons, negations, reported speech), threats (a verb of violence counts only
with a person as its object, and as aimed only if the first person announces it), negation (a hit within ``REACH`` words
behind a negation, not across commas and conjunctions), reported speech (hits behind a verb of saying in the same clause),
aim (a hit that is said of the second person: "you idiot", "you are ... a ... idiot", "..., idiot" between commas or ends
in a clause that speaks to somebody, "... idiot you are"), and weights (a cost for each class of hit and each other word).
The tropical shortest path through the composition reads a clause; its cost is the clause's score, and the costs of all
clauses, of the words outside of matched clauses and of the start add up to the text's: the score is the logistic
function of minus that sum. So one insult that is not aimed, negated and reported hits, and verbs of violence without a
person stay below one half by themselves, one aimed insult or announced threat does not, and different insults add up. A
bare repetition is no further hit: an unaimed hit counts like any other word if its word was a hit before in its clause, or
if its clause has no other words and follows on such clauses with that word.

Costs are learned from labelled rows: a logistic regression with a ridge to prior costs, within bounds that impose the
order of classes above. Slurs that the fixed list lacks are induced as stems: a stem counts by distinct contexts (word before
and after), so copies of one document count once, and must be far more frequent in toxic rows (log-likelihood ratio of at
least ``EVIDENCE``). The fit reads at most ``SAMPLE`` labelled rows. Empty and null texts get the start's score. Equal
texts get equal scores; an empty table gives an empty result; without labels the prior costs hold. Other columns are
not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, labelled_sample, over_batches, texts

#: Most labelled rows that the fit reads, most stems that it keeps.
SAMPLE = 8192
STEMS = 256
#: Least log-likelihood ratio of an induced stem, and its lengths in letters.
EVIDENCE = 30.0
SHORTEST, LONGEST = 4, 9
#: Words that a negation reaches, and within which a verb of violence needs its target.
REACH = 3
#: Words between an article and its insult, and between a pronoun and the verb of violence whose object it is.
NEAR = 2

# Words and phrases of the grammar (English, German, French, Spanish).
INSULTS = "idiot idiots idiota idiotas moron morons stupid stupide loser losers scum trash clown clowns pathetic worthless disgusting dumb fool fools imbecile imbécile crétin cretin dummkopf trottel arschloch abschaum connard salaud débile estúpido estúpida imbécil basura payaso asqueroso bastard bastards freak jerk vermin"
INSULT_PHRASES = "piece of trash|piece of garbage|waste of space|poor excuse for|shut up|get lost|go to hell|drop dead|good for nothing|halt die klappe|stück dreck|geh zur hölle|ferme ta gueule|fils de chien|va au diable|hijo de perra|vete al infierno|cierra la boca"
VIOLENCE = "kill hurt destroy murder strangle stab shoot beat töten umbringen vernichten verprügeln tuer frapper détruire matar destruir golpear"
THREAT_PHRASES = "watch your back|you will regret|you are dead|i know where you live|kill yourself|du bist tot|tu es mort|estás muerto"
YOU = "you u du ihr tu tú ti usted ustedes vosotros"
YOU_PHRASES = "all of you|both of you|each of you|every one of you"
YOU_ARE = "you're ur"
OBJECTS = "dich dir euch te toi yourself yourselves ihn"
YOU_OR_OBJECT = "vous"
PERSONS = "him them"
HER = "her"
ARE = "are were am bist seid es êtes eres sois"
FIRST = "i we i'm we're ich wir je nous yo"
WILL = "will shall gonna going werden"
FIRST_WILL = "i'll we'll werde vais allons voy vamos"
ARTICLES = "a an the ein eine einen der die das un une una el la le"
FILLERS = "just so really very such total totally complete absolute absolutely utter damn little big old ugly filthy dirty lousy real true einfach nur so echt total vraiment si très tan muy"
FILLER_PHRASES = "not only|nothing but|nothing more than|nicht nur|nichts als|pas seulement|rien que|no solo|no sólo|nada más que"
LINKS = "and or but because if und oder aber weil wenn et ou mais parce si y o pero porque"
NEGATIONS = "not no never isn't aren't don't won't nicht kein keine nie pas jamais nunca ningún"
REPORTED = "said says wrote writes claimed called quoted according sagte schrieb behauptete dit écrit affirmé dijo escribió"

_CLAUSE = re.compile(r"[^.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|,")
HITS = ("insult", "threat", "stem")
MODES = ("plain", "negated", "reported")
CLASSES = tuple((hit, mode, aimed) for hit in HITS for mode in MODES for aimed in (False, True))
OTHER, COMMA = "other", ","
#: Costs before any label is seen: the start, an unaimed hit, an aimed one, and each word that is no hit.
START, UNAIMED, AIMED, WORD_COST = 3.0, -2.2, -4.5, 0.004
#: How much more an aimed, or less an unaimed hit must count than the start, and the weight of the ridge.
MARGIN, RIDGE = 0.5, 0.2


class Readable:
    """What both kinds of transducer share: ``start``, ``reads(state, symbol)`` and ``ends(state)``."""

    def compose(self, then: Readable) -> Composition:
        """The transducer that reads what ``self`` reads and writes what ``then`` writes; costs add up."""
        return Composition(self, then)

    def shortest(self, symbols: list) -> tuple[float, list]:
        """Cost and outputs of the tropical shortest path; infinite and [] if no path accepts."""
        best = {self.start: (0.0, None, None)}
        steps = []
        for symbol in symbols:
            after: dict = {}
            for state, (cost, _, _) in best.items():
                for out, more, to in self.reads(state, symbol):
                    if to not in after or cost + more < after[to][0]:
                        after[to] = (cost + more, state, out)
            steps.append(after)
            best = after
        ends = [(cost + end, repr(s), s) for s, (cost, _, _) in best.items() if (end := self.ends(s)) is not None]
        if not ends:
            return float("inf"), []
        cost, _, state = min(ends)
        outs = []
        for step in reversed(steps):
            _, back, out = step[state]
            outs.append(out)
            state = back
        return cost, outs[::-1]


@dataclass
class Transducer(Readable):
    """States are any values; ``arcs[state][symbol]`` lists (output, cost, next state); ``final`` has final costs."""

    start: object
    arcs: dict = field(default_factory=lambda: defaultdict(lambda: defaultdict(list)))
    final: dict = field(default_factory=dict)

    def arc(self, state, symbol, out, cost, to) -> None:
        self.arcs[state][symbol].append((out, cost, to))

    def reads(self, state, symbol) -> list:
        return self.arcs[state].get(symbol, [])

    def ends(self, state) -> float | None:
        return self.final.get(state)


class Composition(Readable):
    """Two transducers in a row; pairs of states are made when a text first reaches them, at most once each."""

    def __init__(self, first: Readable, then: Readable):
        self.first, self.then, self.start, self.known = first, then, (first.start, then.start), {}

    def reads(self, state, symbol) -> list:
        found = self.known.get((state, symbol))
        if found is None:
            a, b = state
            found = [(last, cost + more, (a2, b2)) for mid, cost, a2 in self.first.reads(a, symbol) for last, more, b2 in self.then.reads(b, mid)]
            self.known[state, symbol] = found
        return found

    def ends(self, state) -> float | None:
        one, two = self.first.ends(state[0]), self.then.ends(state[1])
        return None if one is None or two is None else one + two


_WORDS = [
    ("filler", FILLERS), ("article", ARTICLES), ("link", LINKS), ("first", FIRST), ("will", WILL), ("first will", FIRST_WILL), ("are", ARE), ("her", HER), ("person", PERSONS), ("object", OBJECTS),
    ("you or object", YOU_OR_OBJECT), ("you are", YOU_ARE), ("you", YOU), ("reported", REPORTED), ("negation", NEGATIONS), ("violence", VIOLENCE), ("insult", INSULTS),
]
_SINGLE = {w: symbol for symbol, words in _WORDS for w in words.split()} | {COMMA: COMMA}
_PHRASES = [(p.split(), symbol) for symbol, ps in (("insult", INSULT_PHRASES), ("threat", THREAT_PHRASES), ("you", YOU_PHRASES), ("filler", FILLER_PHRASES)) for p in ps.split("|")]
_LONE = {w for p, _ in _PHRASES for w in p}
#: Input symbols: the words of the lists, a comma, ``stem`` and ``other``.
ALPHABET = sorted({*_SINGLE, *_LONE, "stem", OTHER})
#: What words become: hits and symbols that are none.
RAW_HITS = ("insult", "stem", "threat", "assault")
QUIET = ("you", "you or object", "you are", "object", "person", "her", "are", "first", "will", "first will", "article", "filler", "link", COMMA, OTHER)


def phrases() -> Transducer:
    """Words to symbols. A set phrase writes its symbol at its last word and is a little cheaper than its words."""
    t = Transducer((), final={(): 0.0})
    for w in ALPHABET:
        t.arc((), w, "stem" if w == "stem" else _SINGLE.get(w, OTHER), 0.0, ())
    for words, symbol in _PHRASES:
        for k, w in enumerate(words):
            arc = (symbol, -1e-3, ()) if k + 1 == len(words) else ("filler", 0.0, tuple(words[: k + 1]))
            if arc not in t.arcs[tuple(words[:k])][w]:
                t.arc(tuple(words[:k]), w, *arc)
    return t


def threats() -> Transducer:
    """Verbs of violence are threats if the first person announces them to a person, assaults if to the second person.

    States: how far an announcement is ("", "first" behind I or we, "will" behind "I will"), and what the verb waits for:
    nothing, its object as the next word ("object"), the end of the object ("end", as in "kill her."), or, ahead of the
    verb, how many words since a pronoun that may be its object (numbers).
    """
    t = Transducer(("", None))
    for said in ("", "first", "will"):
        t.final[said, None] = t.final[said, "end"] = 0.0
        for n in range(NEAR + 1):
            t.final[said, n] = 0.0
        for wait in (None, "end", *range(NEAR + 1)):
            for symbol in ("insult", "stem", "threat", "violence", "negation", "reported", *QUIET):
                if wait == "end" and symbol not in (COMMA, "link"):
                    continue
                if symbol == "first":
                    now = "first"
                elif symbol == "first will" or (symbol == "will" and said == "first"):
                    now = "will"
                elif symbol in (COMMA, "you", "you are") or (said == "first" and symbol not in ("are", "filler")):
                    now = ""
                else:
                    now = said
                left = wait - 1 if isinstance(wait, int) and wait and symbol not in (COMMA, "link") else None
                if symbol in ("first", "will", "first will") and isinstance(wait, int):
                    left = wait
                if symbol in ("object", "you or object"):
                    left = NEAR
                if symbol != "violence":
                    t.arc((said, wait), symbol, symbol, 0.0, (now, left))
                    continue
                kind = "threat" if said == "will" else "assault"
                t.arc((said, wait), symbol, OTHER, 0.0, (now, left))
                t.arc((said, wait), symbol, kind, -1e-3, (said, None) if isinstance(wait, int) else (said, "object"))
        for symbol in ("you", "you or object", "object"):
            t.arc((said, "object"), symbol, symbol, 0.0, (said, None))
        if said == "will":
            t.arc((said, "object"), "person", "person", 0.0, (said, None))
            t.arc((said, "object"), "her", "her", 0.0, (said, "end"))
    return t


def negation() -> Transducer:
    """Hits behind a negation are negated ones; the negation itself may stand for the verb ("you aren't")."""
    t = Transducer(0, final=dict.fromkeys(range(REACH + 1), 0.0))
    for left in range(REACH + 1):
        to = max(left - 1, 0)
        for hit in RAW_HITS:
            t.arc(left, hit, (hit, "negated" if left else "plain"), 0.0, to)
        for symbol in ("reported", *QUIET):
            t.arc(left, symbol, symbol, 0.0, 0 if symbol in (COMMA, "link") else to)
        t.arc(left, "negation", "are", 0.0, REACH)
    return t


def reported_speech() -> Transducer:
    t = Transducer(False, final={False: 0.0, True: 0.0})
    for inside in (False, True):
        for hit in RAW_HITS:
            for mode in ("plain", "negated"):
                t.arc(inside, (hit, mode), (hit, "reported" if inside and mode == "plain" else mode), 0.0, inside)
        t.arc(inside, "reported", OTHER, 0.0, True)
        for symbol in QUIET:
            t.arc(inside, symbol, symbol, 0.0, inside)
    return t


def aim() -> Transducer:
    """Says of each hit whether it is aimed at the second person. Threats are, assaults are not.

    States: whether the clause has spoken to somebody ("no", "yes", or "owed" by a hit that needs it), and the place:
    "open" (at the start or behind a comma), "in", "you" (right behind the pronoun), "are" (a verb before its pronoun),
    "be" (behind "you are"), numbers ("you are a", with so many words to go), "closing" (behind "..., idiot"; a comma or the
    end must follow), "promise" ("idiot" of "what an idiot you are") and "promised you".
    """
    t = Transducer(("no", "open"))
    places = ("open", "in", "you", "are", "be", *range(NEAR + 1), "closing", "promise", "promised you")
    for seen in ("no", "yes", "owed"):
        for place in places:
            state = (seen, place)
            bound = place in ("closing", "promise", "promised you")
            if seen != "owed" and place not in ("promise", "promised you"):
                t.final[state] = 0.0
            for mode in MODES:
                for hit in ("insult", "stem"):
                    said = (hit, mode)
                    if not bound:
                        t.arc(state, said, (*said, False), 1e-6, (seen, "in"))
                        t.arc(state, said, (*said, True), 1e-7, (seen, "promise"))
                    if place in ("you", "be") or isinstance(place, int):
                        t.arc(state, said, (*said, True), 0.0, state)
                    if place in ("open", "closing"):
                        t.arc(state, said, (*said, True), 1e-7, ("yes" if seen == "yes" else "owed", "closing"))
                if not bound:
                    t.arc(state, ("threat", mode), ("threat", mode, True), 0.0, ("yes", "in"))
                    t.arc(state, ("assault", mode), ("threat", mode, False), 0.0, (seen, "in"))
            for symbol in QUIET:
                out = COMMA if symbol == COMMA else OTHER
                if place == "promise":
                    to = {"you": ("yes", "promised you"), "you or object": ("yes", "promised you"), "you are": ("yes", "closing")}.get(symbol)
                elif place == "promised you":
                    to = ("yes", "closing") if symbol == "are" else None
                elif place == "closing":
                    to = (seen, "open") if symbol == COMMA else None
                elif symbol in ("you", "you or object"):
                    to = ("yes", "be" if place == "are" else "you")
                elif symbol == "you are":
                    to = ("yes", "be")
                elif symbol == "object":
                    to = ("yes", "in")
                elif symbol == "are":
                    to = (seen, "be" if place in ("you", "be") else "are")
                elif symbol == COMMA:
                    to = (seen, "open")
                elif symbol == "link":
                    to = (seen, "be" if place == "be" or isinstance(place, int) else "in")
                elif symbol == "filler" and place != "are":
                    to = state
                elif symbol == "article" and place == "be":
                    to = (seen, NEAR)
                elif isinstance(place, int) and place and symbol == OTHER:
                    to = (seen, place - 1)
                else:
                    to = (seen, "in")
                if to:
                    t.arc(state, symbol, out, 0.0, to)
    return t


UNWEIGHTED = phrases().compose(threats()).compose(negation()).compose(reported_speech()).compose(aim())


def weights(costs: np.ndarray) -> Transducer:
    """Keeps symbols and adds the cost of each class of hit, or of a word; commas cost nothing."""
    t = Transducer(0, final={0: 0.0})
    for c, cost in zip((*CLASSES, OTHER), costs[1:], strict=True):
        t.arc(0, c, c, float(cost), 0)
    t.arc(0, COMMA, COMMA, 0.0, 0)
    return t


def prior_costs() -> np.ndarray:
    """Of the start, of each class, and of a word."""
    return np.array([START, *((AIMED if aimed else UNAIMED) if mode == "plain" else WORD_COST for _, mode, aimed in CLASSES), WORD_COST])


def bounded(costs: np.ndarray) -> np.ndarray:
    """The nearest costs in the order that the grammar stands for.

    The start is 2 at least; negated and reported hits cost what words do; an unaimed hit outweighs the start by
    ``-MARGIN`` at most and counts half a unit at least, an aimed one by ``MARGIN`` at least.
    """
    c = costs.copy()
    c[0], c[-1] = np.clip(c[0], 2.0, 8.0), np.clip(c[-1], 0.0, 0.02)
    for i, (_, mode, aimed) in enumerate(CLASSES, 1):
        if mode != "plain":
            c[i] = c[-1]
        elif aimed:
            c[i] = min(c[i], -c[0] - MARGIN)
        else:
            c[i] = min(max(c[i], -c[0] + MARGIN), -0.5)
    return c


@dataclass
class ToxicModel:
    stems: tuple[str, ...] = ()
    costs: np.ndarray = field(default_factory=prior_costs)

    def __post_init__(self):
        lone = sorted((w for w, s in _SINGLE.items() if s in ("insult", "violence")), key=len, reverse=True)
        fixed = [*lone, *(r"[^\w\n.!?;]+".join(map(re.escape, p)) for p, _ in _PHRASES)]
        parts = [rf"(?:{'|'.join(fixed)})(?![^\W_])"]
        if self.stems:
            parts.append(f"(?:{'|'.join(map(re.escape, sorted(self.stems)))})")
        self.trigger = re.compile(rf"(?<![^\W_])(?:{'|'.join(parts)})")
        self.stem = re.compile("|".join(map(re.escape, sorted(self.stems)))) if self.stems else re.compile(r"(?!)")
        self.grammar = UNWEIGHTED.compose(weights(self.costs))

    def __getstate__(self):
        return {"stems": self.stems, "costs": self.costs}

    def __setstate__(self, state):
        self.__init__(**state)

    def symbol(self, word: str) -> str:
        return word if word in _SINGLE or word in _LONE else "stem" if self.stem.match(word) else OTHER

    def clauses(self, text: str) -> list[tuple[int, int, float, list, int, list]]:
        """(start, end, cost, classes of hits, number of words, words of the hits) of the clauses with a hit; positions in the lower-cased text."""
        found = [m.start() for m in self.trigger.finditer(text)]
        if not found:
            return []
        spans = [m.span() for m in _CLAUSE.finditer(text)]
        starts = [a for a, _ in spans]
        out = []
        for k in sorted({bisect_right(starts, at) - 1 for at in found}):
            a, b = spans[k]
            words = _WORD.findall(text, a, b)
            cost, outs = self.grammar.shortest([self.symbol(w) for w in words])
            hits = [(x, w) for x, w in zip(outs, words, strict=False) if x not in (OTHER, COMMA)]
            if hits:
                out.append((a, b, cost, [x for x, _ in hits], len(words) - words.count(COMMA), [w for _, w in hits]))
        return out

    def costs_of(self, text: str | None) -> tuple[float, np.ndarray, int]:
        """A text's cost, its counts (1, hits of each class, words that are no hits) and the number of its hits.

        Bare repetitions of an unaimed hit's word count as words.
        """
        low = (text or "").lower().replace("\u2019", "'")
        matched = self.clauses(low)
        counts, before, end = Counter(), set(), 0
        for a, b, _, hits, n, words in matched:
            bare = n == len(words)
            here = set(before) if bare and not _WORD.search(low, end, a) else set()
            for hit, word in zip(hits, words, strict=True):
                if hit[1:] != ("plain", False) or word not in here:
                    counts[hit] += 1
                here.add(word)
            before, end = here if bare else set(), b
        words = max(len(low.split()), sum(n for *_, n, _ in matched))
        x = np.array([1.0, *(counts[c] for c in CLASSES), words - sum(counts.values())])
        return float(x @ self.costs), x, sum(len(hits) for _, _, _, hits, _, _ in matched)

    def score(self, text: str | None) -> tuple[float, int]:
        """Between 0 and 1, and the number of hits."""
        cost, _, n = self.costs_of(text)
        return float(1 / (1 + np.exp(np.clip(cost, -500, 500)))), n


def induce_stems(sample: DataFrame) -> tuple[str, ...]:
    """Word beginnings that are far more frequent, by distinct contexts, in toxic than in other labelled rows."""
    words = sample.select("y", F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    near = words.select(
        "y", F.explode(F.arrays_zip(
            F.col("w").alias("word"),
            F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), F.size("w") - 1)).alias("before"),
            F.concat(F.slice("w", F.lit(2), F.size("w") - 1), F.array(F.lit(""))).alias("after"),
        )).alias("c"))
    once = near.select("y", F.col("c.word").alias("word"), F.xxhash64("c.before", "c.word", "c.after").alias("context")).where((F.length("word") >= SHORTEST) & ~F.col("word").isin(*_SINGLE)).distinct()
    by_word = once.groupBy("word").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    total = by_word.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0")).collect()[0]
    t1, t0 = float(total.t1 or 0), float(total.t0 or 0)
    if not t1 or not t0:
        return ()
    sizes = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    by_stem = by_word.select(F.explode(F.transform(sizes, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("stem"), "n1", "n0").groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    n = F.col("n1") + F.col("n0")
    part = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("n1"), t1 / (t1 + t0)) + part(F.col("n0"), t0 / (t1 + t0)))
    rows = by_stem.where((F.col("n1") / t1 > 8 * F.col("n0") / t0) & (F.col("n1") >= 5)).withColumn("ratio", ratio).where(F.col("ratio") >= EVIDENCE)
    kept: list[str] = []
    for r in rows.orderBy(F.desc("ratio"), F.desc(F.length("stem")), "stem").limit(8 * STEMS).collect():
        if len(kept) < STEMS and not any(r.stem.startswith(k) or k.startswith(r.stem) for k in kept):
            kept.append(r.stem)
    return tuple(kept)


def learned_costs(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Bounded costs of the least logistic loss with a ridge to the prior ones, by projected gradient steps."""
    prior = bounded(prior_costs())
    scale = np.append(np.ones(x.shape[1] - 1), 1e-3)  # words are many, their cost is small
    loss = lambda c: np.logaddexp(0, (2 * y - 1) * np.clip(x @ c, -50, 50)).sum() + RIDGE * (((c - prior) / scale) ** 2).sum()
    c, rate, now = prior, 0.1, loss(prior)
    for _ in range(steps):
        z = x @ c
        pull = np.where(np.abs(z) < 50, y - 1 / (1 + np.exp(np.clip(z, -50, 50))), 0.0)
        step = scale**2 * (x.T @ pull) + 2 * RIDGE * (c - prior)
        after = bounded(c - rate * step)
        value = loss(after)
        if value < now:
            if now - value < 1e-7 * now:
                break
            c, now, rate = after, value, rate * 1.5
        else:
            rate /= 4
            if rate < 1e-12:
                break
    return c


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> ToxicModel:
    """Induce stems and learn costs on at most ``bound`` labelled rows that are not held out."""
    sample = checkpointed(labelled_sample(docs, labels, label, bound))
    model = ToxicModel(induce_stems(sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [shared.value.costs_of(t)[1].tobytes() for t in batch["text"].to_pylist()]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    rows = over_batches(sample, features, "doc_id long, y int, x binary").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(bound).collect()
    y = np.array([r.y for r in rows], float)
    if len(set(y)) == 2:
        x = np.frombuffer(b"".join(bytes(r.x) for r in rows)).reshape(len(rows), -1)
        model = ToxicModel(model.stems, learned_costs(x, y))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) and the number of hits in matched clauses."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(t) for t in batch["text"].to_pylist()]
        s, hits = np.array([f[0] for f in found], float), pa.array([f[1] for f in found], pa.int64())
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s), pa.array((s >= threshold).astype(np.int32)), hits], ["doc_id", "score", "predicted", "hits"])

    return over_batches(texts(docs), score, "doc_id long, score double, predicted int, hits long")


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """The rows and columns of ``docs`` whose text scores under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([shared.value.score(t)[0] < threshold for t in batch["text"].to_pylist()], pa.bool_()))

    return over_batches(docs, keep, docs.schema)
