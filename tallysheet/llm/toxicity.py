"""Toxicity: obfuscated words are restored by a noisy-channel decoder, then texts are scored.

1. One pass over all documents counts character trigrams (the language model's counts, of
   every whole text) and, for a bounded sample of labelled rows, in how many toxic and
   other texts each word and word beginning occurs.
2. Words and beginnings that speak for toxicity form the lexicon. The character language
   model mixes the corpus trigrams with those of the lexicon's words.
3. A second pass restores suspect pieces and scores every text. A piece is a run of letters,
   digits and signs; it is suspect if a digit or sign stands beside a letter or a letter
   stands three times. Runs of three or more single characters, whatever stands between
   them, are one piece with a possible word break at each gap. A piece is a lattice: each
   place offers the letters that a digit or sign may stand for, a repeated letter may be
   dropped. The Viterbi path is the reading of highest probability, language model and
   channel together. Two or three neighbouring pieces are read as one word too if that word
   is in the lexicon. The restored words are read besides the plain ones.
4. The score is a logistic function of the strongest evidence, the second strongest, the
   sum of it and its share; its weights are fitted on other labelled rows than the lexicon.

Labels are learned only from rows whose crc32(id as text) mod 4 is not 2: remainders 0 and
1 give the lexicon, 3 the weights. At most ``max_labelled`` rows of each kind are used,
those of lowest crc32 of the reversed id. Labels, lang, source and ids are no inputs.

Defined results: null and empty texts are scored like texts without evidence; without
usable labels (none of one class) every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import compress, repeat
from operator import eq, not_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.words import steps, texts_of

THRESHOLD = 0.3
#: Labelled rows used for the lexicon, and for the weights.
MAX_LABELLED = 20_000
#: Entries of the lexicon.
MAX_LEXICON = 50_000
#: Lengths of word beginnings that are read as evidence.
BEGINNINGS = range(4, 9)

WORD = re.compile(r"[^\W\d_]+")
#: Letters that a digit or sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou",
}
#: Runs of letters, digits and signs that may stand for letters.
PIECE = re.compile(r"(?:[^\W_]|[@$!|+*])+")
#: The same where no underline is: one class of characters is read faster.
RUN = re.compile(r"[\w@$!|+*]+")
#: A digit or sign beside a letter, or a letter three times.
SUSPECT = re.compile(r"[^\W\d_][\d@$!|+*]|[\d@$!|+*][^\W\d_]|([^\W\d_])\1\1")
LETTER = re.compile(r"[^\W\d_]")
#: A letter three times, in a token of letters alone.
THREE_ALIKE = re.compile(r"(.)\1\1")
#: What has to stand in a text that holds a suspect piece other than by repetition.
SUBSTITUTE = re.compile(r"[\d@$!|+*]")
#: Signs that end a word in plain writing.
ENDS = "!|+*"
#: Letters that must follow each other in a word of the lexicon if they do in a piece read as one.
GRAM = 4
#: Single characters in a row that are read as a word spelled out.
SPELLED = 3
THREE_SINGLE = b"\x01" * SPELLED
NOTHING: frozenset[str] = frozenset()
#: Costs of the channel.
SUBSTITUTED, DROPPED, BROKEN = 1.0, 0.4, 1.0
LETTERS = 28  # 0: none, 1..26: a..z, 27: another letter
CODES = bytes(27 if b >= 128 else b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 0 for b in range(256))


def codes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.translate(CODES), np.uint8).astype(np.int64)


def trigrams(raw: bytes) -> np.ndarray:
    c = codes(b"  " + raw + b" ")
    return np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a letter after two others, smoothed."""
    table = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float) + 0.05
    return np.log(table / table.sum(axis=2, keepdims=True))


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


class Choices(dict):
    """What a character may stand for, by the character and whether it repeats the one before: number of the letter (or -1), cost, letter."""

    def __missing__(self, key: tuple[str, bool]) -> list[tuple[int, float, str]]:
        c, again = key
        if c in STANDS_FOR:
            found = [(x, SUBSTITUTED) for x in STANDS_FOR[c]] + [("", 2.0)]
        elif c.isalpha():
            found = [(c, 0.0)] + ([("", DROPPED)] if again else [])
        elif c == " ":
            found = [("", 0.0), (" ", BROKEN)]
        else:
            found = [("", 0.0)]
        self[key] = out = [(letter(x) if x else -1, cost, x) for x, cost in found]
        return out


CHOICES = Choices()


#: Two or more digits and signs that may stand for letters.
SIGNS = re.compile("([" + re.escape("".join(STANDS_FOR)) + "]{2,})")
#: Runs of signs whose paths a task keeps.
KEPT_RUNS = 100_000
Paths = dict[int, tuple[float, str]]


def _extended(paths: Paths, part: str, flat: list[float]) -> Paths:
    """The best path to each state after some more characters."""
    before, read = "", 0
    while read < len(part):
        if len(paths) == 1:
            # one path stays one while characters stand for themselves
            ((state, (value, text)),) = paths.items()
            for c in part[read:]:
                choices = CHOICES[c, c == before]
                if len(choices) > 1:
                    break
                (number, cost, x), before, read = choices[0], c, read + 1
                if number < 0:
                    value -= cost
                else:
                    value, state = value - cost + flat[state * LETTERS + number], state % LETTERS * LETTERS + number
                text += x
            paths = {state: (value, text)}
            if read == len(part):
                return paths
        c = part[read]
        choices, before, read = CHOICES[c, c == before], c, read + 1
        after: dict[int, tuple[float, str]] = {}
        for state, (value, text) in paths.items():
            for number, cost, x in choices:
                if number < 0:
                    to, found = state, value - cost
                else:
                    to, found = state % LETTERS * LETTERS + number, value - cost + flat[state * LETTERS + number]
                known = after.get(to)
                if known is None or found > known[0]:
                    after[to] = (found, text + x)
        paths = after
    return paths


def decoded(token: str, flat: list[float], runs: dict[tuple[int, str], Paths]) -> str:
    """The most probable reading of a token's lattice; a space is a word break or nothing.

    flat: the language model by number of the two letters before and of the letter. runs: the
    paths through runs of signs from the states met so far; the same few stand beside many words.
    """
    paths: Paths = {0: (0.0, "")}
    parts = SIGNS.split(token)
    for i, part in enumerate(parts):
        if i % 2 == 0:
            paths = _extended(paths, part, flat)
            continue
        after: Paths = {}
        for state, (value, text) in paths.items():
            through = runs.get((state, part))
            if through is None:
                if len(runs) > KEPT_RUNS:
                    runs.clear()
                through = runs[state, part] = _extended({state: (0.0, "")}, part, flat)
            if len(paths) == 1:
                if i == len(parts) - 2 and not parts[-1]:
                    # the token ends here: all its readings begin alike
                    return text + max([(value + more + flat[to * LETTERS], x) for to, (more, x) in through.items()])[1]
                after = {to: (value + more, text + x) for to, (more, x) in through.items()}
                continue
            for to, (more, x) in through.items():
                known = after.get(to)
                if known is None or value + more > known[0]:
                    after[to] = (value + more, text + x)
        paths = after
    return max((value + flat[state * LETTERS], text) for state, (value, text) in paths.items())[1]


def restore(token: str, model: np.ndarray) -> str:
    """The most probable reading of a single token."""
    return decoded(token, model.ravel().tolist(), {})


def pieces_of(low: str) -> list[str]:
    """The matches of PIECE."""
    return RUN.findall(low.replace("_", " "))


def plain(piece: str) -> bool:
    """Whether all characters are letters other than the one before, so a piece has one reading: itself."""
    return piece.isalpha() and not any(map(eq, piece, piece[1:]))


class Counted(dict):
    """How many words and beginnings a token has; a new token is counted by ``count``."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def __missing__(self, token: str) -> int:
        self[token] = n = self.count(token)
        return n


def evidence(word: str) -> list[str]:
    """The word as a whole and its beginnings."""
    return ["=" + word, *[word[:k] for k in BEGINNINGS[: max(0, len(word) - BEGINNINGS[0])]]]


class Reader:
    """Evidence in texts, with the lexicon and the language model known."""

    def __init__(self, lexicon: dict[str, float], model: np.ndarray):
        self.lexicon, self.names, self.model = lexicon, frozenset(lexicon), model.ravel().tolist()
        self.whole = {name[1:] for name in lexicon if name[0] == "="}
        self.starts = {w[:k] for w in self.whole for k in range(len(w) + 1)}
        self.stops = {w[k:] for w in self.whole for k in range(len(w) + 1)}
        self.grams = {w[k : k + GRAM] for w in self.whole for k in range(len(w) - GRAM + 1)}
        #: The longest word with up to GRAM first and last letters.
        self.longest: dict[tuple[str, str], int] = {}
        for w in self.whole:
            for a in {w[:k] for k in range(GRAM + 1)}:
                for b in {w[max(0, len(w) - k) :] for k in range(GRAM + 1)}:
                    self.longest[a, b] = max(len(w), self.longest.get((a, b), 0))
        self.first = {name[: BEGINNINGS[0]] for name in lexicon if name[0] != "="}
        self.known = Counted(self.token)
        #: Evidence of the known tokens that have some.
        self.found: dict[str, frozenset[str] | set[str]] = {}
        self.telling: set[str] = set()
        self.pieces: dict[str, set[str]] = {}
        self.runs: dict[tuple[int, str], Paths] = {}

    def token(self, token: str) -> int:
        """How many words and beginnings a token has; those in the lexicon are kept; also as restored."""
        alone = token.isalpha()
        words = {token} if alone else set(WORD.findall(token))
        if THREE_ALIKE.search(token) if alone else SUSPECT.search(token):
            words.update(w for piece in pieces_of(token) for w in self.restored(piece))
        if len(words) == 1:
            (word,) = words
            n = 1 + min(max(0, len(word) - BEGINNINGS[0]), len(BEGINNINGS))
            # without its first beginning a word has none of the others
            found = self.names.intersection(evidence(word)) if word[: BEGINNINGS[0]] in self.first or word in self.whole else NOTHING
        else:
            parts = {p for w in words for p in evidence(w)}
            n, found = len(parts), parts & self.names
        if found:
            self.found[token] = found
            self.telling.add(token)
        return n

    def readings(self, piece: str) -> set[str]:
        """A suspect piece as restored, with and without the signs at its end and its stars."""
        if not SUSPECT.search(piece):
            return set()
        ways = {piece, piece.rstrip(ENDS), piece.replace("*", "")}
        return {x if plain(x) else decoded(x, self.model, self.runs) for x in ways if LETTER.search(x)}

    def spelled(self, pieces: list[str], marked: bool) -> set[str]:
        """Words spelled out as single characters; marked: there may be a `!` behind one."""
        words, run = set(), []
        if not marked and THREE_SINGLE not in bytes(map(min, map(len, pieces), repeat(2))):
            return words
        for piece in [*pieces, ""]:
            if len(piece) == 1 or (len(piece) == 2 and piece[1] == "!"):
                run.append(piece[0])
                continue
            if len(run) >= SPELLED and any(map(LETTER.match, run)):
                words.update(decoded(" ".join(run), self.model, self.runs).split())
            run = []
        return words

    def joined(self, pieces: list[str], substitutes: bool) -> set[str]:
        """Words of the lexicon that are split in two or three pieces."""
        words, starts, stops, whole, last = set(), self.starts, self.stops, self.whole, len(pieces) - 1
        # a word's first piece is one of its beginnings, its last one of its ends
        for i in compress(range(last), map(starts.__contains__, pieces)):
            piece = pieces[i]
            if pieces[i + 1] in stops or (i + 1 < last and pieces[i + 2] in stops):
                if pieces[i + 1] in stops and piece + pieces[i + 1] in whole:
                    words.add(piece + pieces[i + 1])
                if i + 1 < last and pieces[i + 2] in stops and piece + pieces[i + 1] + pieces[i + 2] in whole:
                    words.add(piece + pieces[i + 1] + pieces[i + 2])
        if not substitutes:
            return words
        signed = compress(range(len(pieces)), map(not_, map(str.isalpha, pieces)))
        suspect = [i for i in signed if SUSPECT.search(pieces[i])]
        for n in (2, 3):
            for i in {i - k for i in suspect for k in range(n)}:
                # letters that no reading drops are the beginning of a word, or it is none of the lexicon
                if 0 <= i <= len(pieces) - n and (pieces[i] in starts or not plain(pieces[i])):
                    run = "".join(pieces[i : i + n])
                    if self.may_be_whole(run):
                        words.update(self.whole.intersection(self.restored(run)))
        return words

    def may_be_whole(self, piece: str) -> bool:
        """Whether words of the lexicon have the first, the last and the successive letters of a piece that no reading drops."""
        low, high = 0, len(piece)
        while low < high and piece[low].isalpha() and (not low or piece[low] != piece[low - 1]):
            low += 1
            # a beginning has all its own beginnings
            if piece[:low] not in self.starts:
                return False
        while high and piece[high - 1].isalpha() and (high == 1 or piece[high - 1] != piece[high - 2]):
            high -= 1
        if piece[:low] not in self.starts or piece[high:] not in self.stops:
            return False
        longest = self.longest.get((piece[:low][:GRAM], piece[high:][-GRAM:]), 0)
        if len(piece) > longest:
            # one reading is without stars, so letters beside them may repeat each other
            left = piece.replace("*", "")
            if sum([c.isalpha() and c != before for before, c in zip(" " + left, left, strict=False)]) > longest:
                return False
        return all(run[k : k + GRAM] in self.grams for run in WORD.findall(piece) if plain(run) for k in range(len(run) - GRAM + 1))

    def restored(self, piece: str) -> set[str]:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) > 400_000:
                self.pieces.clear()
            found = self.pieces[piece] = self.readings(piece)
        return found

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        tokens, pieces = set(low.split()), pieces_of(low)
        tokens |= self.spelled(pieces, "!" in low) | self.joined(pieces, SUBSTITUTE.search(low) is not None)
        if len(self.known) > 400_000:
            # between texts only: a text needs all its tokens
            self.known.clear()
            self.found.clear()
            self.telling.clear()
        total = sum(map(self.known.__getitem__, tokens))
        seen = set().union(*map(self.found.__getitem__, tokens & self.telling))
        strong = sorted((self.lexicon[p] for p in seen), reverse=True)
        return [1.0, strong[0] if strong else 0.0, strong[1] if len(strong) > 1 else 0.0, sum(strong) / 10, sum(strong) / math.sqrt(total + 5)]


def remainder(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def _counted(sample) -> Callable:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, labelled = np.zeros(LETTERS**3, np.int64), sample.value
        for batch in steps(batches, "text"):
            toxic, other = Counter(), Counter()
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                letters += trigrams((text or "").encode("utf-8", "surrogatepass"))
                if i in labelled:
                    found = {p for w in set(WORD.findall((text or "").lower())) for p in evidence(w)}
                    (toxic if labelled[i] else other).update(found)
            names = list(toxic.keys() | other.keys())
            yield _counts([0] * len(names), names, [toxic[x] for x in names], [other[x] for x in names])
        some = np.flatnonzero(letters)
        yield _counts([1] * len(some), [str(x) for x in some], letters[some], [0] * len(some))

    return counted


def _counts(kind, name, toxic, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(name, pa.string()), pa.array(toxic, pa.int64()), pa.array(other, pa.int64())],
        ["kind", "name", "toxic", "other"],
    )


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(len(w))
        w += np.linalg.solve(curve, x.T @ (y - p) - 0.02 * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Lexicon, language model and weights. docs: id, text; labels: id, toxic."""
    context = docs.sparkSession.sparkContext
    by = remainder(F.col("id"))
    usable = labels.filter("id is not null and toxic is not null").withColumn("part", by)
    order = F.crc32(F.reverse(F.col("id").cast("string")).cast("binary"))

    def sample(parts: list[int]) -> dict:
        rows = usable.filter(F.col("part").isin(parts)).orderBy(order, "id", "toxic").limit(max_labelled).select("id", "toxic").collect()
        return {r["id"]: int(r["toxic"]) for r in rows}

    first, second = sample([0, 1]), sample([3])
    n_toxic, n_other = sum(first.values()), len(first) - sum(first.values())
    counted = docs.mapInArrow(_counted(context.broadcast(first)), "kind int, name string, toxic bigint, other bigint")
    counted = counted.groupBy("kind", "name").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    sure = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    speaks = (F.col("kind") == 0) & (F.col("toxic") >= 3) & (odds > 1) & (sure > 2.5)
    # the letters are LETTERS ** 3 rows at most
    rows = counted.filter((F.col("kind") == 1) | speaks).select("kind", "name", "toxic", odds.alias("odds"), sure.alias("sure")).orderBy(F.desc("kind"), F.desc("sure"), "name").limit(LETTERS**3 + MAX_LEXICON).collect()
    letters, from_words = np.zeros(LETTERS**3), np.zeros(LETTERS**3)
    for r in rows:
        if r["kind"]:
            letters[int(r["name"])] = r["toxic"]
    lexicon = {r["name"]: r["odds"] for r in rows if not r["kind"]}
    for name in lexicon:
        if name[0] == "=":
            from_words += trigrams(name[1:].encode())
    model = log_model(letters / max(1, letters.sum()) + from_words / max(1, from_words.sum()) * 0.5)
    reader = context.broadcast((lexicon, model))
    if not (0 < sum(second.values()) < len(second)) or not n_toxic:
        return lexicon, model, np.zeros(0)
    labelled = context.broadcast(second)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, known = Reader(*reader.value), labelled.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keep = [i for i, x in enumerate(ids) if x in known]
            texts = batch.take(pa.array(keep, pa.int64())).column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([known[ids[i]] for i in keep], pa.int32()), pa.array([read.features(t) for t in texts], pa.list_(pa.float64()))], ["y", "x"]
            )

    found = docs.mapInArrow(features, "y int, x array<double>").limit(2 * max_labelled).collect()
    if not found:
        return lexicon, model, np.zeros(0)
    return lexicon, model, fit(np.array([r["x"] for r in found]), np.array([r["y"] for r in found]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Columns id_col, held_out, score (0 to 1), predicted (score of THRESHOLD or more)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    lexicon, model, weights = learn(rows, labels.select(labels[id_col].alias("id"), labels[label_col].alias("toxic")), max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, model, weights))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model, weights = shared.value
        reader = Reader(lexicon, model)
        for batch in steps(batches, "text"):
            texts = texts_of(batch, "text")
            if len(weights):
                value = np.clip(np.array([reader.features(t) for t in texts]).reshape(len(texts), -1) @ weights, -30, 30)
                score = 1 / (1 + np.exp(-value))
            else:
                score = np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(scored, f"id {kind}, score double")
    return found.select(
        F.col("id").alias(id_col), F.coalesce(remainder(F.col("id")) == 2, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
