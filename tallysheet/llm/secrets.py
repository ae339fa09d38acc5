"""Secret scans: candidates are judged by a random forest, so that false positives go.

Candidates are all cores of a word, that is 12 or more of ``[A-Za-z0-9_+/.@-]`` with a digit,
and whatever is assigned to a name of credentials (``password = "hunter2"``). A
candidate's features are its length and kinds of characters, its transitions between kinds
of characters and between vowels and consonants, the share covered by dictionary words
(the most frequent words of the corpus, counted over all documents), its path (the source,
as a number) and its neighbouring words: an assignment before it, a word that names
credentials, quotes. The forest is trained from labelled findings; labels that nobody has
given are derived from forms whose meaning is certain (``certain_label``). Its training
rows are a bounded sample: ``max_findings`` by hash.

All of it are DataFrame functions and Spark's own forest.

Defined results: null and empty texts have no candidates; equal candidates in one text are
findings of their own; with findings of one class only, that class is the score of all;
equal rows give equal findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.session import stage

# a run is looked at from its start only, so one of any length takes time in proportion
CORE = r"(?<![A-Za-z0-9_+/.@-])(?=[A-Za-z_+/.@-]*+[0-9])[A-Za-z0-9_+/.@-]{12,}+"
WHITE = r"[\x20\x09-\x0D]+"
#: Words that name credentials.
NAMES = r"token|secret|password|passwd|pwd|api_?key|access_?key|credential|auth"
#: The start of a word whose assignment stands in the words before it.
LED = "\u0001"
#: What is assigned to a name of credentials, in the word itself or in those before.
VALUE = (
    rf"(?:(?<=(?i:{NAMES})[A-Za-z0-9_-]{{0,20}}[\"']?[=:]{{1,2}}[\"']{{0,1}})|(?<=^{LED}[=:]{{0,2}}[\"']{{0,1}}))"
    rf"[^\x20\x09-\x0D{LED}\"'`,;&<>(){{}}\[\]=:][^\x20\x09-\x0D\"'`,;&<>(){{}}\[\]]*"
)
CANDIDATE = f"{VALUE}|{CORE}"
MAX_FINDINGS = 20_000
DICTIONARY = 400
FEATURES = (
    "length digits upper lower signs kinds_change vowel_change distinct_share hex_only dictionary_share "
    "path named assigned quoted before_length after_length has_at has_dot"
).split()


def dictionary(docs: DataFrame, text_col: str, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of 3 to 10 letters a-z, counted over all texts."""
    words = F.explode(F.regexp_extract_all(F.lower(docs[text_col]), F.lit(r"\b([a-z]{3,10})\b"), 1))
    counted = docs.select(words.alias("word")).groupBy("word").count()
    return [r["word"] for r in counted.orderBy(F.desc("count"), "word").limit(size).collect()]


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """Columns id, path, place (number of the word in the text), part (number of the candidate in the word), value, word, before, before2, after.

    ``word`` is the candidate with what stands before it in its word, up to the candidate
    before, and one character after it; all the rest after the last one.
    """
    some = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[path_col].cast("string").alias("path"))
    some = some.filter(F.col("text").rlike(CORE) | F.col("text").rlike(f"(?i){NAMES}")).select("id", "path", F.split("text", WHITE).alias("words"))
    at = lambda i: F.when(i >= 0, F.coalesce(F.get("words", i), F.lit(""))).otherwise("")
    near = F.transform("words", lambda word, i: F.struct(i.alias("place"), word.alias("all"), at(i - 1).alias("before"), at(i - 2).alias("before2"), at(i + 1).alias("after")))
    found = some.select("id", "path", F.explode(near).alias("near")).select("id", "path", "near.*")
    led = F.concat_ws(" ", "before2", "before").rlike(rf"(?i)({NAMES})[\w-]*[\"']? ?[=:]{{1,2}}$") | (
        F.col("before").rlike(rf"(?i)({NAMES})[\w-]*[\"']?$") & F.col("all").rlike("^[=:]{1,2}[^=:]")
    )
    marked = found.withColumn("all", F.concat(F.when(led, F.lit(LED)).otherwise(""), F.col("all"))).filter(F.col("all").rlike(CANDIDATE))
    cut = marked.withColumn("values", F.regexp_extract_all("all", F.lit(CANDIDATE), 0)).withColumn("around", F.split("all", CANDIDATE, -1))
    last = F.size("values") - 1
    head = lambda k: F.regexp_replace(F.replace(F.get("around", k), F.lit(LED), F.lit("")), F.when(k > 0, F.lit("^[^A-Za-z_]+(?=[A-Za-z_])")).otherwise(F.lit("^$")), F.lit(""))
    tail = lambda k: F.when(k == last, F.get("around", k + 1)).otherwise(F.substring(F.get("around", k + 1), 1, 1))
    parts = F.transform("values", lambda v, k: F.struct(
        k.alias("part"), v.alias("value"), F.concat(head(k), v, tail(k)).alias("word"),
        F.when(k > 0, F.get("values", k - 1)).otherwise(F.col("before")).alias("before"), F.when(k > 0, F.lit("")).otherwise(F.col("before2")).alias("before2"),
        F.when(k < last, F.get("values", k + 1)).otherwise(F.col("after")).alias("after"),
    ))
    return cut.select("id", "path", "place", F.explode(parts).alias("found")).select("id", "path", "place", "found.*")


def _share(pattern: str, value: Column) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.greatest(F.length(value), F.lit(1))


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """found with a double column per feature."""
    value, low = F.col("value"), F.lower("value")
    runs = F.regexp_extract_all(low, F.lit(r"([a-z]{3,})"), 1)
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    in_dictionary = F.aggregate(runs, F.lit(0), lambda n, run: n + F.when(F.array_contains(known, run), F.length(run)).otherwise(0))
    columns = {
        "length": F.length(value), "digits": _share("[0-9]", value), "upper": _share("[A-Z]", value), "lower": _share("[a-z]", value),
        "signs": _share("[^A-Za-z0-9]", value),
        "kinds_change": _share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])", value),
        "vowel_change": _share("(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])", low),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "hex_only": low.rlike("^[0-9a-f]+$"), "dictionary_share": in_dictionary / F.length(value),
        "path": F.crc32(F.coalesce("path", F.lit("")).cast("binary")) % 64,
        "named": F.lower(F.concat_ws(" ", "before2", "before", "word")).rlike(NAMES),
        "assigned": F.col("before").rlike("[=:]$") | F.col("word").rlike("^[^A-Za-z0-9_]*[A-Za-z_-]+[\"']?[=:]"),
        "quoted": F.col("word").rlike("^[A-Za-z_]*[=:]?[\"'].*[\"']"),
        "before_length": F.length("before"), "after_length": F.length("after"),
        "has_at": value.contains("@"), "has_dot": value.contains("."),
    }
    assert list(columns) == FEATURES
    return found.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})


def certain_label() -> Column:
    """1 for forms that are credentials, 0 for forms that are not, null for others."""
    text = F.concat_ws(" ", "before2", "before", "word")
    credential = F.lower(text).rlike(rf"({NAMES})\w*[\"']? ?[=:] ?[\"']?[a-z0-9_+/-]{{12,}}") | F.col("value").rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$")
    other = F.col("value").rlike(r"@[\w-]+(\.[\w-]+)+$|^[0-9.+/-]+$|^[0-9]{13,19}$")
    return F.when(credential, 1).when(other, 0)


def train(findings: DataFrame, label: Column, max_findings: int = MAX_FINDINGS, trees: int = 24, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel | float | None:
    """A forest from the findings with a label; the label itself if there is only one; None without any."""
    labelled = findings.withColumn("label", label.cast("double")).filter("label is not null")
    sample = stage(labelled.orderBy(F.crc32(F.concat_ws("/", "id", "place").cast("binary")), "id", "place", "part", "value").limit(max_findings).select("label", *FEATURES))
    classes = sorted(r["label"] for r in sample.select("label").distinct().limit(3).collect())
    if len(classes) < 2:
        return classes[0] if classes else None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def score(findings: DataFrame, model: RandomForestClassificationModel | float | None) -> DataFrame:
    """findings with the column score: the forest's share for a secret."""
    if model is None or isinstance(model, float):
        return findings.withColumn("score", F.lit(0.0 if model is None else model))
    judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings))
    return judged.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labels: DataFrame | None = None, threshold: float = 0.5, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """Columns id_col, place, part, value, score, is_secret: every candidate with the forest's verdict.

    labels: columns id, place, label of findings already judged, and part if a word has several; without them certain_label
    is used on the documents whose crc32(id as text) mod 4 is not 2.
    """
    found = stage(features(candidates(docs, id_col, text_col, path_col), dictionary(docs, text_col)))
    if labels is None:
        kept = F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2
        model = train(found, F.when(kept, certain_label()), max_findings)
    else:
        where = [c for c in ("id", "place", "part") if c in labels.columns]
        model = train(found.join(labels.select(*where, F.col("label").alias("given")), where), F.col("given"), max_findings)
    judged = score(found, model)
    return judged.select(F.col("id").alias(id_col), "place", "part", "value", "score", (F.col("score") >= threshold).alias("is_secret"))
