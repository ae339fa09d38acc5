"""Fingerprints, readings, scores and the pipeline against plain Python."""

import hashlib
import itertools
import math
import random
import sys

import pytest
from pyspark.sql import functions as F

from tallysheet.llm import spotsigs, toxicity

WORDS = "the of and stone river light under seven paper cloud winter glass road moon letter table north wheel".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.4 else "") for _ in range(n))


# --- op6 ---------------------------------------------------------------------------------------

def plain_chains(text):
    blank = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    words = "".join(" " if c in blank else c for c in text.lower()).split(" ")
    words = [w for part in words for w in part.encode().split()]
    anchors = {w.encode() for w in spotsigs.ANCHORS}
    chains = set()
    for i, w in enumerate(words):
        if w in anchors:
            content = [x for x in words[i + 1 :] if x not in anchors][: spotsigs.CHAIN]
            if len(content) == spotsigs.CHAIN:
                chains.add((w, *content))
    return chains or {("whole", text)}


def plain_likeness(a, b):
    return len(a & b) / len(a | b)


def test_fingerprints_of_awkward_texts(spark):
    rng = random.Random(11)
    texts = [None, "", " ", "the", "of the and", "the stone", "Été de la mer et le sel du lac", "日本語", "x" * 50_000, "the a b c " * 500]
    texts += [prose(rng, rng.choice([3, 12, 60, 200])) for _ in range(150)]
    texts += [texts[20], texts[21] + " moon", texts[22].upper()]
    rows = [(3 * i + 1, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string").repartition(4)
    found = {r.doc_id: r for r in spotsigs.neighbour_likeness(docs).collect()}
    sets = {}
    for k, (i, t, _) in enumerate(rows):
        own, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        r = found[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(own)
        a, b, c = plain_chains(own), plain_chains(edited), plain_chains(following)
        assert r.near_edited == pytest.approx(plain_likeness(a, b)) and r.near_next == pytest.approx(plain_likeness(a, c))
        sets.setdefault(r.fingerprint, set()).add(frozenset(a))
        assert (r.fingerprint == r.edited_fingerprint) == (a == b)
    assert all(len(s) == 1 for s in sets.values())


# --- op10 --------------------------------------------------------------------------------------

def all_readings(token, model):
    """Every path of the lattice with its value."""
    ways = []
    for i, c in enumerate(token):
        if c in toxicity.STANDS_FOR:
            ways.append([(x, toxicity.SUBSTITUTED) for x in toxicity.STANDS_FOR[c]] + [("", 2.0)])
        elif c.isalpha():
            ways.append([(c, 0.0)] + ([("", toxicity.DROPPED)] if i and token[i - 1] == c else []))
        else:
            ways.append([("", 0.0)] + ([(" ", toxicity.BROKEN)] if c == " " else []))
    for path in itertools.product(*ways):
        a = b = 0
        value, text = 0.0, ""
        for x, cost in path:
            if x:
                value, a, b, text = value - cost + model[a, b, toxicity.letter(x)], b, toxicity.letter(x), text + x
            else:
                value -= cost
        yield value + model[a, b, 0], text


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    words = ["idiot", "stupid", "loser", "the", "stone", "table", "useless", "noon", "aloe"]
    return toxicity.log_model(sum(toxicity.trigrams(" ".join(rng.choice(words) for _ in range(30)).encode()) for _ in range(20)))


def test_the_reading_is_the_best_path(model):
    rng = random.Random(2)
    for _ in range(300):
        token = "".join(rng.choice("aeiosdt01345$!| é") for _ in range(rng.randrange(1, 8)))
        best = max(all_readings(token, model))
        value = max(v for v, t in all_readings(token, model) if t == toxicity.restore(token, model))
        assert value == pytest.approx(best[0])


def plain_features(reader, lexicon, model, text):
    low = (text or "").lower()
    pieces = toxicity.PIECE.findall(low)

    def readings(piece):
        if not toxicity.SUSPECT.search(piece):
            return set()
        return {toxicity.restore(x, model) for x in {piece, piece.rstrip(toxicity.ENDS), piece.replace("*", "")} if toxicity.LETTER.search(x)}

    whole = {name[1:] for name in lexicon if name[0] == "="}
    tokens, run = set(low.split()), []
    for piece in [*pieces, ""]:
        if len(piece) == 1 or (len(piece) == 2 and piece[1] == "!"):
            run.append(piece[0])
            continue
        if len(run) >= toxicity.SPELLED and any(map(toxicity.LETTER.match, run)):
            tokens.update(toxicity.restore(" ".join(run), model).split())
        run = []
    for n in (2, 3):
        for i in range(len(pieces) - n + 1):
            some = pieces[i : i + n]
            joined = "".join(some)
            if joined in whole:
                tokens.add(joined)
            if any(not p.isalpha() and toxicity.SUSPECT.search(p) for p in some):
                tokens.update(readings(joined) & whole)
    seen, total = set(), 0
    for token in tokens:
        words = {token} if token.isalpha() else set(toxicity.WORD.findall(token))
        if toxicity.SUSPECT.search(token):
            words.update(w for piece in toxicity.PIECE.findall(token) for w in readings(piece))
        parts = {p for w in words for p in ["=" + w, *(w[:k] for k in range(4, 9) if len(w) > k)]}
        total += len(parts)
        seen |= parts & lexicon.keys()
    strong = sorted((lexicon[p] for p in seen), reverse=True)
    return [1.0, strong[0] if strong else 0.0, strong[1] if len(strong) > 1 else 0.0, sum(strong) / 10, sum(strong) / math.sqrt(total + 5)]


def test_evidence_of_awkward_texts(model):
    rng = random.Random(3)
    lexicon = {"=idiot": 3.0, "=stupid": 2.5, "stup": 1.5, "=useless": 2.0, "usel": 1.2, "=loser": 1.1}
    pieces = [
        "the", "stone", "idiot", "1d10t", "i d i o t", "i.d.1.0.t", "idi ot", "st up id", "5tupid", "stuuupid!!", "u5el355", "l0s", "er", "a", "I", "!", "us3",
        "less", "42", "1,000", "été", "...", "useless,", "Stupid?", "$tup1d", "aaa", "b00k", "st*pid",
    ]
    texts = [None, "", " ", *[" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(400)]]
    reader = toxicity.Reader(lexicon, model)
    for text in texts:
        assert reader.features(text) == pytest.approx(plain_features(reader, lexicon, model, text)), text


# --- pipeline ----------------------------------------------------------------------------------

def test_pipeline_on_planted_rows(spark, tmp_path):
    import public_tokenizers
    import tiktoken
    import base64

    sys.path.insert(0, ".")
    import corpus_pipeline

    rng = random.Random(4)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8))) for _ in range(n))

    common, base = "This common line stands in many documents of the corpus.", text(200).split()
    near = list(base)
    near[100] = "changed"
    rows = [(i, text(60) + "\n" + text(40), "en", "s", 0) for i in range(12)]
    rows += [(20 + i, text(50) + "\n" + common, "en", "s", 0) for i in range(4)]
    rows += [(30, " ".join(base), "en", "s", 0), (31, " ".join(near), "en", "s", 0)]
    rows += [(40, "too short", "en", "s", 0), (41, None, "en", "s", None), (42, "", "en", "s", 0), (43, "word " * 100, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn(
        "mix", F.lit("own")).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {i: t for i, t, *_ in rows if i < 40 and i != 31}
    for i in (21, 22, 23):
        want[i] = want[i].split("\n")[0]
    assert found.keys() == want.keys()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in want.items():
        ids = coder.encode_ordinary(t)
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert found[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
