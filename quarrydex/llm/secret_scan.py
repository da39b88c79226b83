"""Operator 10: secret scans with a random forest that takes out false positives.

A pattern finds candidates of two kinds: long runs of key characters with a digit, and whatever stands behind a secret's
usual name.  DataFrame functions describe each of them and its surroundings, and a random forest trained from labelled
findings decides.  DataFrame and SQL functions and Spark's own (JVM) forest only.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN = r"A-Za-z0-9+/_\-"
#: 14 or more letters, digits and + / _ -, with a digit anywhere.
LONG_RUN = rf"(?<![{_RUN}])(?=[A-Za-z+/_\-]*+[0-9])[{_RUN}]{{14,}}+={{0,2}}"
#: A secret's name, with what may belong to it, and the sign or quote before its value.
_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?)"
NAMED = rf"""(?i:{_NAME}[\w\-]{{0,24}}+(?:["']?[ \t]{{0,3}}(?:=>|:=|[=:])[ \t]{{0,3}}(?:bearer[ \t]+)?["']?|[ \t]{{1,3}}["'])|\bbearer[ \t]+)"""
#: Its value: 6 or more characters other than blanks, quotes and angles, without the punctuation of a sentence at the end.
VALUE = r"""[^\s"'<>]{5,}[^\s"'<>,;.:)\]}]"""
CANDIDATE = rf"({NAMED})({VALUE})|({LONG_RUN})"
#: Texts in which either may be: a digit with enough of a run before or behind it, or a name.
LIKELY = rf"[0-9](?:(?<=[{_RUN}]{{8}})|[{_RUN}]{{7}})"
LIKELY_NAME = r"(?i)pass|pwd|secret|token|[_-]?key|auth|credential|bearer"
#: Stands around candidates while they are cut out; in a text it counts as a blank.
MARK = "\x01"
#: Characters of text before and behind a candidate that its neighbouring words come from.
AROUND = 160
SECRET_WORDS = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private)"
HARMLESS_WORDS = r"(?i)(sha\d*|md5|hash|checksum|digest|commit|revision|uuid|guid|etag|build|order|invoice|isbn|doi|version|session|trace)"
PLACEHOLDER = r"(?i)^([*x.#_-]+|.*(your|example|placeholder|change.?me|redacted|hidden|dummy|sample).*|\$.*|%.*%|\{.*)$"
LABELLED, TREES, DEPTH, THRESHOLD, SEED = 6000, 32, 10, 0.5, 17
#: Words of the corpus that count as dictionary words: the commonest ones of four letters or more.
DICTIONARY = 400

FEATURES = ["length", "digits", "upper", "lower", "other", "hexadecimal", "distinct", "changes", "digit_letter", "longest_letters", "dictionary", "slashes", "dashes", "path_before", "url", "assigned", "quoted", "secret_word", "harmless_word", "vendor", "words_before", "placeholder", "brackets", "symbols"]


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """The ``size`` commonest words of four to nine letters; all texts count."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?<![\p{L}\p{N}])\p{L}{4,9}(?![\p{L}\p{N}])"), F.lit(0))).alias("word"))
    return sorted(r.word for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(size).collect())


def describe(found: DataFrame, known: list[str]) -> DataFrame:
    """``found`` (with before, candidate, behind) and the FEATURES of each candidate."""
    c, n = F.col("candidate"), F.greatest(F.char_length("candidate"), F.lit(1))
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    parts = F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0))
    words = F.array(*[F.lit(w) for w in known]).cast("array<string>")
    covered = F.aggregate(parts, F.lit(0), lambda a, p: a + F.when(F.exists(words, lambda w: p.contains(w)), F.char_length(p)).otherwise(0))
    is_ = lambda x: x.cast("double")
    before, behind = F.col("before"), F.col("behind")
    last_words = F.regexp_extract(before, r"((?:[\w-]+\W+){0,3})$", 1)
    return found.withColumns(
        {
            "length": n.cast("double"),
            "digits": share("[0-9]"),
            "upper": share("[A-Z]"),
            "lower": share("[a-z]"),
            "other": share("[^A-Za-z0-9]"),
            "hexadecimal": is_(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "changes": share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
            "digit_letter": share("(?<=[0-9])[A-Za-z]"),
            "longest_letters": F.array_max(F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.char_length))) / n,
            "dictionary": covered / n,
            "slashes": share("/"),
            "dashes": share("[-_]"),
            "path_before": is_(before.rlike(r"[/\\.]$")),
            "url": is_(before.rlike(r"(?i)(https?://|www\.)\S*$")),
            "assigned": is_(before.rlike(r"[=:]\s*[\"']?$")),
            "quoted": is_(before.rlike("[\"']$") & behind.rlike("^[\"']")),
            "secret_word": is_(last_words.rlike(SECRET_WORDS)),
            "harmless_word": is_(last_words.rlike(HARMLESS_WORDS)),
            "vendor": is_(c.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^xox[abprs]-|^sk_(live|test)_|^AIza|^eyJ")),
            "words_before": F.size(F.regexp_extract_all(F.substring(before, -48, 48), F.lit(r"\w+"), F.lit(0))).cast("double"),
            "placeholder": is_(c.rlike(PLACEHOLDER)),
            "brackets": share(r"[(){}\[\]$%]"),
            "symbols": share(r"[!@#&*^~?|]"),
        }
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nth, before, candidate, behind of every candidate in whole texts.

    Cheap patterns go first, so few texts see the long one, which runs once: it marks the candidates, and the text is
    cut at the marks.  before and behind stay within the line and end at the next candidate.
    """
    text = F.translate("text", MARK, " ")
    parts = F.split(F.regexp_replace(text, CANDIDATE, f"$1{MARK}$2$3{MARK}"), MARK)
    found = F.transform(
        F.sequence(F.lit(1), F.size("parts") - 1, F.lit(2)),
        lambda i: F.struct(
            F.regexp_extract(F.substring(F.element_at("parts", i), -AROUND, AROUND), r"[^\n]*\z", 0).alias("before"),
            F.element_at("parts", i + 1).alias("candidate"),
            F.regexp_extract(F.substring(F.element_at("parts", i + 2), 1, AROUND), r"\A[^\n]*", 0).alias("behind"),
        ),
    )
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .where(F.col("text").rlike(LIKELY) | F.col("text").rlike(LIKELY_NAME))
        .select("doc_id", parts.alias("parts"))
        .where(F.size("parts") > 1)
        .select("doc_id", F.posexplode(found).alias("nth", "x"))
        .select("doc_id", "nth", "x.before", "x.candidate", "x.behind")
    )


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """Labelled findings (before, candidate, behind, label) to start from, the same on each call: made from hashes of row numbers.

    Secrets: cloud keys, tokens, passwords and keys with their usual words around them.  Harmless: identifiers, digests,
    paths, links, dates, numbers and composed words.  Pass your own table to ``train`` where there is one.
    """
    h = lambda k, n=40: F.substring(F.sha1(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")).cast("binary")), 1, n)
    b64 = lambda k, n: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256))), "+/=", "xYz"), 1, n)
    pick = lambda k, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(len(values))) + 1).cast("int"))
    filler = F.concat_ws(" ", pick("f1", "the", "and of", "le des", "der die", "los", "to onedre"), pick("f2", "thing", "erreur", "value", "set", "then", "ungkeit"))
    size = (F.pmod(F.xxhash64(F.lit("s"), F.col("id")), F.lit(24)) + 16).cast("int")
    secret = [
        (F.concat(filler, F.lit(" ")), F.concat(F.lit("AKIA"), F.upper(b64("a", 16)))),
        (F.concat(filler, pick("t", ' token = "', " token: ", ' api_key = "', ' "secret": "', " auth_token=")), h("b")),
        (F.concat(filler, pick("p", " password=", " passwd: ", ' pwd = "', " secret=")), F.substring(h("c"), 1, size)),
        (F.concat(filler, pick("q", " access_key=", ' private_key: "', " api-key: ", " Bearer ")), F.concat(pick("v", "", "ghp_", "sk_live_", "xoxb-"), b64("d", 32))),
        (F.concat(filler, pick("r", " password=", " secret: ")), b64("e", 20)),
        # passwords as people choose them, and keys of letters alone
        (F.concat(filler, pick("p2", " password=", " password: ", " pwd=", ' passwd = "', " PASSWORD: ", ' "password": "', " pass: ")), F.concat(pick("a1", "hunter", "Summer", "dragon", "qwerty", "Tr0ub4dor", "S3cr3t", "monkey", "blue-Horse", "pa55", "LetMe"), pick("a2", "", "!", "&", "@", "#", "_", "$"), F.substring(F.conv(h("a3", 4), 16, 10), 1, 3), pick("a4", "abc", "xkcd!", "", "?", "pass", "Zq", "*"))),
        (F.concat(filler, pick("p3", " api_key=", " token: ", ' secret = "', " access_key: ", ' api-key: "', " auth_token=")), F.substring(F.translate(b64("l", 40), "0123456789", "abcdefghij"), 1, size)),
    ]
    harmless = [
        (F.concat(filler, pick("u", " uuid ", " guid: ", " id ", " request ")), F.concat_ws("-", h("g", 8), h("h", 4), h("i", 4), h("j", 4), h("k", 12))),
        (F.concat(filler, pick("w", " commit ", " sha1 ", " md5: ", " checksum ", " revision ")), F.substring(h("l"), 1, F.when(F.col("id") % 2 == 0, 40).otherwise(32))),
        (F.concat(filler, pick("x", " /usr/lib/", " see https://example.org/", " src/", " file ./")), F.concat_ws("/", pick("y", "share", "python3", "images", "docs"), F.concat(pick("z", "module", "photo-", "report_", "chapter"), h("m", 6)))),
        (F.concat(filler, pick("n", " order ", " invoice no. ", " isbn ", " call ", " ")), F.lpad(F.conv(h("n", 14), 16, 10), 16, "4")),
        (F.concat(filler, F.lit(" ")), F.concat_ws("-", pick("o", "section", "chapter", "release", "covid", "windows"), pick("o2", "number", "edition", "candidate", "update"), F.conv(h("o", 3), 16, 10))),
        (F.concat(filler, F.lit(" on ")), F.concat(F.lit("2024-0"), (F.col("id") % 9 + 1).cast("string"), F.lit("-1"), (F.col("id") % 10).cast("string"), F.lit("T10-00-00"))),
        # what stands behind such names without being secret
        (F.concat(filler, pick("m", " password: ", ' "token": "', " secret: ", " api_key: ", " auth: ", " credentials: ", " Password = ")), pick("m2", "required", "string", "optional", "enabled", "nullable", "boolean", "incorrect", "something", "protected", "forgotten", "undefined", "authentication")),
        (F.concat(filler, pick("o3", " password=", ' token = "', " secret: ", ' api_key: "', " PASSWORD=")), pick("o4", "********", "xxxxxxxx", "${TOKEN}", "$PASSWORD", "your-token-here", "changeme", "YOUR_API_KEY", "{{secret}}", "os.environ[TOKEN]", "getenv(SECRET)", "config.get(password)", "example-password", "REDACTED", "............")),
        (F.concat(filler, pick("o5", " token: ", " auth: ", " password: ", " secret: ")), F.concat(pick("o6", "ertion", "the", "reer", "thing", "ungen", "ción"), pick("o7", "and", "ing", "schen", "ment", "aux", "able"), pick("o8", "", "s", "ly", "en"))),
        (F.concat(filler, pick("o9", " auth: ", " credentials: ", " token: ")), F.concat(F.lit("https://"), pick("o10", "login", "sso", "docs"), F.lit(".example.org/"), pick("o11", "oauth", "token", "help"))),
    ]
    def choose(rows_, which):
        kind = F.pmod(F.xxhash64(F.lit("kind"), F.col("id")), F.lit(len(rows_)))
        out = rows_[0][which]
        for k, r in enumerate(rows_[1:], 1):
            out = F.when(kind == k, r[which]).otherwise(out)
        return out

    label = F.col("id") % 2
    both = lambda which: F.when(label == 1, choose(secret, which)).otherwise(choose(harmless, which))
    before = both(0)
    return spark.range(0, rows, 1, 1).select(before.alias("before"), both(1).alias("candidate"), F.when(before.endswith('"'), F.lit('" ')).otherwise(F.lit(" ")).alias("behind"), label.cast("double").alias("label"))


def train(findings: DataFrame, known: list[str]) -> PipelineModel:
    """A forest from labelled findings (before, candidate, behind, label 0 or 1); rows with a null are left out."""
    rows = describe(findings.na.drop(subset=["before", "candidate", "behind", "label"]), known)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(assembler.transform(rows).select("features", "label"))
    return PipelineModel([assembler, forest])


def scan(docs: DataFrame, model: PipelineModel, known: list[str]) -> DataFrame:
    """doc_id, nth, secret_sha256, kind, score, is_secret: one row for each candidate in ``docs``.

    nth numbers the candidates of a row's text from 0.  Null and empty texts have none; rows that repeat are scanned each.
    The string itself isn't returned.  score is the forest's probability, is_secret whether it is at least THRESHOLD.
    """
    c = F.col("candidate")
    kind = F.when(c.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$"), "cloud key").when(F.col("secret_word") == 1, "named").when(F.col("hexadecimal") == 1, "hexadecimal").otherwise("other")
    scored = model.transform(describe(candidates(docs), known))
    score: Column = vector_to_array("probability")[1]
    return scored.select("doc_id", "nth", F.sha2(c, 256).alias("secret_sha256"), kind.alias("kind"), F.round(score, 6).alias("score"), (score >= THRESHOLD).alias("is_secret"))


def secret_report(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``scan`` with a forest trained on ``findings``, or on ``labelled_findings`` where there are none; nulls, repeats and empty tables as in ``scan``."""
    spark = docs.sparkSession
    known = dictionary(docs)
    return scan(docs, train(labelled_findings(spark) if findings is None else findings, known), known)
