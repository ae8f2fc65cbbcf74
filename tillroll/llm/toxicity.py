"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

1. The lexicon is learned from labelled documents: words and word beginnings that toxic documents
   hold and hardly any clean one, more often than chance explains.
2. Its trie is intersected with Levenshtein automata. The states of the product are sets of
   (trie node, edits so far), made when first reached and kept, so reading a word costs one look-up
   a letter, and a word far from every term is given up after a few letters.
3. Every hit is weighed by the words around it: inside quotation marks or near a word of
   reporting it counts as quoted, near a word of address as aimed at somebody.
4. A logistic model over the sums of hits gives the score.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored, training_marks

#: A term must be in this many toxic texts, be this many times as likely there as in clean ones, and be spread
#: over both as it is by chance at most so often. None of the three grows with the texts learned from.
MIN_TEXTS, MIN_RATIO, MAX_CHANCE = 3, 25.0, 1e-6
#: Lengths of the word beginnings that can be terms.
STEMS = range(4, 8)
#: Words left and right of a hit that decide how it counts.
WINDOW = 6
REPORTING = frozenset(
    "said says wrote writes quoted quotes called reported claimed sagte schrieb zitierte nannte dijo escribió citó "
    "llamó dit écrit cité appelé".split()
)
ADDRESS = frozenset("you your you're du dein ihr euch tú tu te vous toi".split())
_QUOTES = "\"“”„«»"
_EDGES = ".,;:!?()[]{}<>|…-–—'’`&%#*$=+~^_/\\" + _QUOTES
#: Words whose match is kept in a task; a word that was let go is read again.
CACHE_WORDS = 300_000
#: Members of all automaton states kept in a task; states that were let go are made again.
CACHE_MEMBERS = 3_000_000


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGES) for x in text.lower().split()) if w]


def edits_allowed(term: str) -> int:
    """Misspellings a term may have: short terms none, long ones two."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Lexicon:
    """Trie of terms, read through their Levenshtein automata.

    A term that ends in * is a word beginning: what follows it is free. `match` gives the fewest
    edits (insertion, deletion, exchange of a letter, swap of neighbours) from the word to a
    term that allows as many, and that term; or None. `terms` says how many each term allows.
    """

    def __init__(self, terms: dict[str, int]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.open: list[bool] = [False]
        self.most: list[int] = [0]
        self.terms: list[str] = [""]
        for term, k in sorted(terms.items()):
            word, node = term.rstrip("*"), 0
            if not word:
                continue
            self.most[0] = max(self.most[0], k)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                    self.open.append(False)
                    self.most.append(0)
                    self.terms.append("")
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node] = max(k, self.ends[node])
            self.open[node] |= term.endswith("*")
            self.terms[node] = term
        self.cache: dict[str, tuple[int, str] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.members: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.final: list[tuple[int, str] | None] = []
        self.held = 0
        self.start = self._state({(0, 0, "")}, None)

    def _state(self, fresh: set, best: tuple[int, int] | None) -> int:
        """The number of the state with these members, skipped letters of terms included.

        A member is (node, edits, letter): a letter other than "" means that two letters are being
        swapped, and the node's child by that letter comes next. `best`: edits and node of a word
        beginning that has been read already.
        """
        todo, all_ = list(fresh), set(fresh)
        while todo:
            node, e, held = todo.pop()
            if held:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and (child, e + 1, "") not in all_:
                    all_.add((child, e + 1, ""))
                    todo.append((child, e + 1, ""))
        least: dict[tuple, int] = {}
        for node, e, held in all_:
            if e < least.get((node, held), 99):
                least[node, held] = e
        members = tuple(sorted((node, e, held) for (node, held), e in least.items()))
        for node, e, held in members:
            if not held and self.open[node] and e <= self.ends[node] and (best is None or (e, node) < best):
                best = (e, node)
        if (members, best) not in self.states:
            self.states[members, best] = len(self.members)
            self.members.append(members)
            self.held += len(members)
            self.steps.append({})
            self.found.append(best)
            ends = [(e, node) for node, e, held in members if not held and e <= self.ends[node]]
            least_end = min([*ends, *([] if best is None else [best])], default=None)
            self.final.append(None if least_end is None else (least_end[0], self.terms[least_end[1]]))
        return self.states[members, best]

    def _step(self, state: int, letter: str) -> int:
        fresh: set[tuple] = set()
        for node, e, held in self.members[state]:
            if held:
                # The first of two swapped letters was read: the one held back must come now.
                child = self.children[node].get(letter)
                then = self.children[child].get(held) if child is not None else None
                if then is not None:
                    fresh.add((then, e, ""))
                continue
            if e + 1 <= self.most[node]:
                fresh.add((node, e + 1, ""))
            for c, child in self.children[node].items():
                if c == letter:
                    fresh.add((child, e, ""))
                elif e + 1 <= self.most[child]:
                    fresh.add((child, e + 1, ""))
                    if letter in self.children[child]:
                        fresh.add((node, e + 1, letter))
        return self._state(fresh, self.found[state])

    def match(self, word: str) -> tuple[int, str] | None:
        if word in self.cache:
            return self.cache[word]
        if self.held > CACHE_MEMBERS:
            self._forget()
        state = self.start
        for letter in word:
            steps = self.steps[state]
            nxt = steps.get(letter)
            if nxt is None:
                nxt = steps[letter] = self._step(state, letter)
            state = nxt
            if not self.members[state]:
                break
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = self.final[state]
        return self.final[state]


FEATURES = ("hits", "misspelt", "quoted", "aimed", "density")


def hit_features(text: str, lexicon: Lexicon) -> list[float]:
    """Logarithms of hits outside quotation, misspelt ones among them, quoted ones, aimed ones, hits per 100 words.

    A misspelt hit counts as a hit, and by its own weight as more or less than that.
    """
    raw = text.lower().split()
    if not raw:
        return [0.0] * len(FEATURES)
    match = lexicon.match
    hits = [(i, d) for i, x in enumerate(raw) if (d := match(x.strip(_EDGES))) is not None]
    if not hits:
        return [0.0] * len(FEATURES)
    marks = [i for i, x in enumerate(raw) for c in x if c in _QUOTES] if any(c in text for c in _QUOTES) else []
    direct = misspelt = quoted = aimed = 0
    for i, (edits, _) in hits:
        near = {x.strip(_EDGES) for x in raw[max(0, i - WINDOW) : i + WINDOW + 1]}
        before = bisect_left(marks, i) + sum(c in _QUOTES for c in raw[i][: len(raw[i]) - len(raw[i].lstrip(_EDGES))])
        if before % 2 == 1 and before < len(marks) or near & REPORTING:
            quoted += 1
            continue
        direct += 1
        misspelt += edits > 0
        aimed += bool(near & ADDRESS)
    return np.log1p([direct, misspelt, quoted, aimed, 100 * direct / len(raw)]).tolist()


def _counts(train: DataFrame) -> DataFrame:
    """term, bad, good: toxic and clean documents that hold the word or word beginning."""

    def run(batches):
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(words_of(text or ""))
                count[label].update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k})
                if len(count[0]) + len(count[1]) > 500_000:
                    yield _term_batch(*count)
                    count = (Counter(), Counter())
        yield _term_batch(*count)

    rows = train.select("label", "text").mapInArrow(run, "term string, bad long, good long")
    return rows.groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _term_batch(good: Counter, bad: Counter) -> pa.RecordBatch:
    terms = list(good.keys() | bad.keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (bad, good))], names=["term", "bad", "good"]
    )


def _evident(counts: DataFrame, bad: int, good: int) -> DataFrame:
    """The rows of `counts` that may be terms.

    By chance each text that holds a word is toxic as often as any text is; that as many as here are has
    at most a chance of exp(-evidence) (Chernoff's bound).
    """
    n, share = F.col("bad") + F.col("good"), bad / (bad + good)
    ratio = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("good") + 0.5) / (good + 1))
    clean = F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share)))).otherwise(0.0)
    evidence = F.col("bad") * F.log(F.col("bad") / (n * share)) + clean
    return counts.filter(F.col("bad") >= MIN_TEXTS).filter((ratio >= MIN_RATIO) & (evidence >= -float(np.log(MAX_CHANCE))))


def learn_lexicon(train: DataFrame) -> dict[str, int]:
    """Terms from `train` (text, label 0 or 1) with the edits each allows; none if a class is missing.

    Terms are counted and picked in Spark; those picked reach the driver. Each is in MIN_TEXTS toxic
    texts at least, so they are at most a third of the words and beginnings of the toxic texts, of which there are
    at most TRAINING_ROWS. Of terms that begin alike, the longest one that has nearly all the documents
    of the shorter one stands for both. A term that words of clean documents lie close to allows no edits.
    """
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    often = {r["term"]: r["bad"] for r in _evident(_counts(train), bad, good).collect()}
    good_terms = sorted(often, key=lambda t: (len(t.rstrip("*")), "*" not in t, t))
    by_word = sorted(often)
    kept: set[str] = set()
    for term in good_terms:
        word = term.rstrip("*")
        if any(word[:k] + "*" in kept for k in STEMS if k <= len(word)):
            continue
        longer, at = [], bisect_left(by_word, word)
        while at < len(by_word) and by_word[at].startswith(word):
            if often[by_word[at]] >= 0.9 * often[term]:
                longer.append(by_word[at])
            at += 1
        kept.add(min(longer, key=lambda t: (-len(t.rstrip("*")), "*" in t, t)))
    terms = {t: edits_allowed(t.rstrip("*")) for t in sorted(kept)}
    close = _close_words(train, terms)
    return {t: k if close.get((t, 1), 0) / bad >= MIN_RATIO * close.get((t, 0), 0) / good else 0 for t, k in terms.items()}


def _close_words(train: DataFrame, terms: dict[str, int]) -> dict[tuple[str, int], int]:
    """Documents per term and label with a misspelling of the term."""

    def run(batches):
        lexicon, count = Lexicon(terms), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = map(lexicon.match, words_of(text or ""))
                count.update((t, label) for t in {x[1] for x in found if x and x[0]})
        if count:
            rows = [pa.array(c) for c in zip(*((t, k, n) for (t, k), n in count.items()))]
            yield pa.RecordBatch.from_arrays([rows[0], rows[1].cast(pa.int32()), rows[2].cast(pa.int64())], names=["term", "label", "n"])

    rows = train.select("label", "text").mapInArrow(run, "term string, label int, n long")
    return {(r["term"], r["label"]): r["n"] for r in rows.groupBy("term", "label").agg(F.sum("n").alias("n")).collect()}


def _fit_logistic(sums: list[tuple[tuple[float, ...], int, int]], ridge: float = 1.0) -> list[float]:
    """Weights and, last, the intercept, over distinct feature rows with their numbers of clean and toxic."""
    x = np.array([[*f, 1.0] for f, _, _ in sums])
    n0, n1 = (np.array([r[i] for r in sums], float) for i in (1, 2))
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n1 - (n0 + n1) * p) - keep @ w
        step = np.linalg.solve((x * ((n0 + n1) * p * (1 - p))[:, None]).T @ x + keep, gradient)
        w = w + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(train: DataFrame) -> dict:
    """Lexicon and weights from `train` (text, label).

    Features are rounded to two digits and counted, so that what reaches the driver is the number
    of distinct rows; rows with no hit are one of them.
    """
    terms = learn_lexicon(train)
    kinds = train.select("label", "text").mapInArrow(_measuring(terms, 2), "label int, features array<double>")
    rows = kinds.groupBy("features").agg(
        F.sum((F.col("label") == 0).cast("long")).alias("clean"), F.sum((F.col("label") == 1).cast("long")).alias("toxic")
    ).collect()
    sums = [(tuple(r["features"]), r["clean"], r["toxic"]) for r in rows] or [((0.0,) * len(FEATURES), 1, 0)]
    return {"terms": terms, "weights": _fit_logistic(sums)}


def _measuring(terms: dict[str, int], digits: int | None = None):
    def run(batches) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            rows = [hit_features(x or "", lexicon) for x in batch.column(1).to_pylist()]
            if digits is not None:
                rows = [[round(v, digits) for v in r] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["_key", "features"]
            )

    def named(batches):
        for out in run(batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=["label", "features"])

    return named if digits is not None else run


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) per row of `docs`.

    A null or empty text has no hit and gets the score of the intercept. Repeated rows are scored
    each; an empty table gives no rows.
    """
    terms, weights = model["terms"], model["weights"]

    def run(batches):
        lexicon, w = Lexicon(terms), np.array(weights)
        for batch in batches:
            x = np.array([hit_features(t or "", lexicon) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=[key, "score"])

    slim = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    return slim.mapInArrow(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, score double")


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, learn, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """text, label of the documents to learn from, stored: those of `training_marks`.

    Each text counts once, so that a group of copies makes no term. Texts are told apart by 64-bit
    hashes; the marks and the keys of the texts to keep are bounded and broadcast, so no text is
    shuffled.
    """
    marks = training_marks(labels, label, learn, key)
    slim = docs.select(F.col(key).alias("_doc"), F.col(text).alias("text"))
    known = slim.join(F.broadcast(marks), F.col("_doc") == F.col("_key"))
    alike = known.groupBy(F.xxhash64("text").alias("_hash"), "label").agg(F.min("_key").alias("_key"))
    once = stored(alike.select("_key", "label").dropDuplicates())
    return stored(slim.join(F.broadcast(once), F.col("_doc") == F.col("_key")).select("text", "label"))


def tester(model: dict, threshold: float):
    """For `keep_rows`: passes texts whose score is under the threshold."""
    terms, weights = model["terms"], model["weights"]

    def start():
        lexicon, w = Lexicon(terms), np.array(weights)
        limit = np.log(threshold / (1 - threshold))
        return lambda texts: [float(np.dot(hit_features(t, lexicon), w[:-1]) + w[-1]) < limit for t in texts]

    return start
