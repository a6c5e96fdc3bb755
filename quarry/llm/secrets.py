"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame operations only."""

from __future__ import annotations

import random
import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import text_or_empty

LEFT, RIGHT = 48, 24
TREES, DEPTH, SEED = 30, 6, 7

# Words that stand beside secrets, words that stand beside harmless identifiers, and key prefixes.
SECRET_WORDS = ["password", "passwd", "pwd", "passphrase", "secret", "token", "api[_-]?key", "apikey", "access[_-]?key", "auth", "bearer", "credential", "private[_-]?key"]
HARMLESS_WORDS = ["uuid", "guid", "sha1", "sha256", "md5", "commit", "checksum", "digest", "etag", "hash", "revision", "version", "isbn", "build", "serial", "order", "invoice", "example", "sample", "file", "image", "path"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk_live_", "rk_live_", "xox[abp]-", "AIza", "eyJ", "glpat-", "npm_", "SG\\."]
#: A run of at least 12 characters of the alphabets of keys and digests with a letter and a digit in it, or a key in three parts behind SG.
KEY = r"(?<![A-Za-z0-9+/_\-])(?:SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|(?=[A-Za-z+/_\-]*+[0-9])(?=[0-9+/_\-]*+[A-Za-z])[A-Za-z0-9+/_\-]{12,}(?:\.[A-Za-z0-9_\-]{8,}){0,2}={0,2})"
#: What is assigned to a secret word: any run of at least 4 characters without space or quote, up to closing punctuation or the next assignment behind & , or ;
ASSIGNED = (
    r"(?<=[=:>\s\"'])(?=[^\s\"']{4})(?<=(?i:" + "|".join(SECRET_WORDS) + r")[\"']?\s{0,3}(?:=>|:=|==?|:|\bis\b)\s{0,3}[\"']?)"
    r"[^\s\"'&,;]*(?:[&,;](?![\w\-]{1,40}[=:])[^\s\"'&,;]*){0,8}(?<![\s\"'.,;)\]}])"
)
#: A candidate; the assigned value comes first, as it may go on where a key's alphabet ends.
CANDIDATE = f"{ASSIGNED}|{KEY}"
DICTIONARY = (
    "about access account after again admin also and any archive are asset back base been before build button but cache can change check class client cluster code common component config content "
    "control could count data date default demo did document does down each error even event example file final find first folder for from function get give good group handle has have header help her "
    "here him his home host how image index info into item its just know last library license like line link list load local login long look main make manager many master member menu message method "
    "model module more most much name network new node not note now number object of old one only option order other our out over page part people place plugin post process profile project public query "
    "read release report request resource response result right root route same sample schema script search see server service session set she should simple size some source start state static status "
    "stream string style such system table take target task team template test than that the their them then there these they thing think this time title type under update use user value version very "
    "video view want was way web well were what when where which who will window with work would year you your"
).split()
#: The most frequent letter pairs of running text.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()

FEATURES = ["n", "transitions", "pairs", "distinct", "digits", "upper", "lower", "symbols", "hex", "coverage", "prefixed", "in_path", "extension", "secret_word", "assigned", "harmless_word", "quoted", "neighbours", "dashes", "placeholder", "assigned_mixed", "assigned_parts"]


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1))


def features(candidates: DataFrame) -> DataFrame:
    """candidates (candidate, left, right) plus FEATURES as doubles; nulls count as empty."""
    c, left, right = (F.coalesce(F.col(x), F.lit("")) for x in ("candidate", "left", "right"))
    low, n = F.lower(c), F.greatest(F.length(c), F.lit(1))
    words = f"(?i)({'|'.join(SECRET_WORDS)})"
    assigned = left.rlike(f"{words}[\"']?\\s*(?:[:=]|=>|:=|is)\\s*[\"']?$")
    placeholder = c.rlike(r"(?i)^(?:your|example|changeme|placeholder|self\.|[<$*{%(])")
    covered = F.regexp_replace(low, "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True)), "")
    made = {
        "n": F.length(c),
        "transitions": (F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / n,
        "pairs": F.regexp_count(low, F.lit(f"(?=(?:{'|'.join(PAIRS)}))")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.sqrt(n),
        "digits": _share(c, "[0-9]"), "upper": _share(c, "[A-Z]"), "lower": _share(c, "[a-z]"), "symbols": _share(c, "[^A-Za-z0-9]"),
        "hex": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "coverage": 1 - F.length(covered) / n,
        "prefixed": c.rlike(f"^(?:{'|'.join(PREFIXES)})"),
        "in_path": left.rlike(r"(?:://\S*|[/\\.@])$") | right.rlike(r"^[/\\@]") | c.rlike("^/|/.*/"),
        "extension": right.rlike(r"^\.[A-Za-z]{2,4}\b"),
        "secret_word": left.rlike(words),
        "assigned": assigned,
        "harmless_word": left.rlike(f"(?i)\\b({'|'.join(HARMLESS_WORDS)})\\b"),
        "quoted": left.rlike("[\"']$") & right.rlike("^[\"']"),
        "neighbours": F.regexp_count(left, F.lit(r"\b[A-Za-z]{2,}\b")) + F.regexp_count(right, F.lit(r"\b[A-Za-z]{2,}\b")),
        "dashes": c.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"),
        "placeholder": placeholder,
        "assigned_mixed": assigned & ~placeholder & c.rlike("[A-Za-z]") & c.rlike("[^A-Za-z._-]"),
        "assigned_parts": F.when(assigned & ~placeholder, F.regexp_count(c, F.lit("[A-Za-z][-._]+(?=[A-Za-z])"))).otherwise(0),
    }
    return candidates.withColumns({k: made[k].cast("double") for k in FEATURES})


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, start (0-based, in characters), length, candidate, left, right: every candidate of every whole text, in order.

    The text is cut at the candidates; a candidate's start is the length of all that comes before it.
    """
    found = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_t")).where(F.col("_t").rlike(CANDIDATE))
    piece = F.transform(F.split("_t", CANDIDATE, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(LEFT)).alias("tail"), F.left(p, F.lit(RIGHT)).alias("head")))
    found = found.select("_id", F.monotonically_increasing_id().alias("_row"), piece.alias("_p"), F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0)).alias("_c"))
    after = F.slice("_p", F.lit(2), F.size("_c"))
    each = found.select("_id", "_row", F.posexplode(F.arrays_zip(F.slice("_p", F.lit(1), F.size("_c")).alias("before"), F.col("_c").alias("c"), after.alias("after"))).alias("at", "x"))
    each = each.select("_id", "_row", "at", F.col("x.before.n").alias("_gap"), F.col("x.c").alias("candidate"), F.col("x.before.tail").alias("left"), F.col("x.after.head").alias("right"))
    step = F.col("_gap") + F.length("candidate")
    upto = Window.partitionBy("_row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(step.cast("long")).over(upto) - F.length("candidate")
    return each.withColumn("start", start).select(F.col("_id").alias(id_col), "start", F.length("candidate").cast("long").alias("length"), "candidate", "left", "right")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from labelled findings: candidate, left, right, label (1: secret). Null labels are left out."""
    rows = features(findings.where(F.col("label").isNotNull())).withColumn("label", F.col("label").cast("double"))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate: id, start, length, candidate, probability, is_secret (probability of at least 0.5).

    Null and empty texts have no candidates; neither has an empty table. Repeated rows repeat their
    candidates. A very long text is one row's work; its candidates are then dealt out.
    """
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(candidates(docs, id_col, text)))
    out = model.transform(rows).withColumn("probability", F.element_at(vector_to_array("probability"), 2))
    return out.select(id_col, "start", "length", "candidate", "probability", (F.col("probability") >= 0.5).alias("is_secret"))


def labelled_findings(spark: SparkSession, n: int = 1500, seed: int = 11) -> DataFrame:
    """A labelled set in the shape that reviewed findings have: n secrets and n harmless strings in context."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: r.choice(DICTIONARY) if r.random() < 0.4 else pick("eothaninsr", r.randint(2, 9))
    prose = lambda k: " ".join(word() for _ in range(k))
    upper = string.ascii_uppercase + string.digits

    def secret() -> tuple[str, str, str]:
        key = r.choice(["password", "passwd", "token", "secret", "api_key", "access_key", "auth", "pwd", "client_secret"])
        q = r.choice(["", "", '"', "'"])
        join = r.choice(["=", " = ", ": ", ":", " is "])
        kind = r.randrange(11)
        if kind > 5:
            key = r.choice(["password", "passwd", "pwd", "passphrase", "secret"])
        if kind == 6:
            return pick(string.ascii_lowercase, r.randint(3, 8)) + pick(string.digits, r.randint(1, 4)) + pick(string.ascii_lowercase, r.randint(0, 3)), f"{prose(4)} {key}{join}{q}", q + " " + prose(2)
        if kind == 7:
            w = list(word().capitalize() + word())
            for i in range(len(w)):
                if r.random() < 0.3:
                    w[i] = {"a": "@", "o": "0", "e": "3", "s": "$", "i": "1"}.get(w[i], w[i])
            return "".join(w) + pick("!#$%*?@+", r.randint(1, 2)) + pick(string.digits, r.randint(1, 4)) + r.choice(["", "", "!"]), f"{prose(4)} {key}{join}{q}", q + " " + prose(2)
        if kind >= 8:
            return r.choice("-._").join(word() for _ in range(r.randint(4, 6))), f"{prose(4)} {key}{join}{q}", q + " " + prose(2)
        if kind == 0:
            return "AKIA" + pick(upper, 16), prose(4) + " ", " " + prose(2)
        if kind == 1 and r.random() < 0.2:
            return f"SG.{pick(alnum, 22)}.{pick(alnum, 43)}", prose(4) + r.choice([" ", ' "', " key "]), " " + prose(2)
        if kind == 1:
            return r.choice(["ghp_", "sk_live_", "glpat-", "npm_", "AIza"]) + pick(alnum, r.choice([24, 36])), prose(4) + r.choice([" ", ' "', " key: "]), " " + prose(2)
        if kind == 2:
            return "eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 30) + "." + pick(alnum + "_-", 30), prose(2) + r.choice([" Bearer ", " token=", " "]), " " + prose(2)
        body = pick(hexes, r.choice([16, 18, 20, 32, 40, 64])) if kind < 5 else pick(alnum + "+/", r.choice([16, 24, 40, 44]))
        return body, f"{prose(4)} {key}{join}{q}", q + " " + prose(2)

    def harmless() -> tuple[str, str, str]:
        kind = r.randrange(11)
        if kind > 8:
            q = r.choice(["", "", '"'])
            plain = r.choice([word, word, lambda: r.choice(["required", "missing", "invalid", "none", "null", "true", "false", "string", "expired", "optional", "****"]), lambda: "self." + word(), lambda: "<your_" + word() + ">", lambda: "${" + word().upper() + "}", lambda: str(r.randint(1000, 9999))])()
            return plain, prose(3) + r.choice([" password", " token", " secret", " auth", " api_key"]) + r.choice([" is ", " is ", ": ", "=", " = "]) + q, q + " " + prose(2)
        if kind == 0:
            u = pick(hexes, 32)
            return f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", prose(3) + r.choice([" id ", " uuid: ", " "]), " " + prose(2)
        if kind == 1:
            return pick(hexes, r.choice([40, 64, 32])), prose(3) + r.choice([" commit ", " sha256: ", " checksum ", " md5 ", " digest="]), " " + prose(2)
        if kind == 2:
            return "/".join([word() for _ in range(r.randint(3, 5))] + [str(r.randint(1, 9999))]), prose(3) + r.choice([" https://", " /", " see "]), r.choice([".html ", "/ ", " "]) + prose(2)
        if kind == 3:
            return "_".join([word() for _ in range(r.randint(2, 4))] + [str(r.randint(1, 99))]), prose(4) + " ", r.choice([".png ", " ", ".py ", "() "]) + prose(2)
        if kind == 4:
            return f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", prose(4) + " ", ":" + prose(2)
        if kind == 5:
            return "".join(w.capitalize() for w in (word(), word(), word(), word())) + str(r.randint(1, 99)), prose(4) + " ", " " + prose(2)
        if kind == 6:
            return pick(upper, 4) + "-" + pick(string.digits, 8) + "-" + pick(upper, 2), prose(3) + r.choice([" order ", " serial ", " invoice ", " build "]), " " + prose(2)
        if kind == 7:
            return "".join(pick("eothaninsr", r.randint(3, 6)) for _ in range(4)) + str(r.randint(0, 9)), prose(4) + " ", " " + prose(2)
        return r.choice(["your", "example", "changeme", "placeholder"]) + "_" + word() + "_" + word() + "_123", prose(3) + r.choice([" password=", " token = ", ' api_key: "']), " " + prose(2)

    rows = [(*make(), label) for label, make in ((1, secret), (0, harmless)) for _ in range(n)]
    return spark.createDataFrame([(c, left[-LEFT:], right[:RIGHT], label) for c, left, right, label in rows], "candidate string, left string, right string, label int")
