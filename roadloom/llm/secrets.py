"""Secret scans: broad candidates, then a random forest that removes false positives. DataFrame operations only.

A candidate is a run within a word, of at least ``MIN_CHARS`` key characters, that holds a digit and a letter
or starts like a well-known credential; a word can have several. Its features are length, character transitions and classes, how
much of it words of a dictionary cover, whether the path looks like tests or lock files, and whether the
neighbouring words speak of credentials or of checksums. The forest is trained on the driver from labelled
findings (``labelled_findings`` where the caller has none) and compiled into one column.
"""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import trees
from roadloom.llm.common import SPACE

MIN_CHARS, MAX_TRAIN = 16, 20_000
TREES, DEPTH, SEED = 30, 6, 11
_KEY = r"[A-Za-z0-9+/_-]"
#: A run of key characters; equals signs belong to it as padding, not between a name and its value.
_RUN = f"{_KEY}{{{MIN_CHARS},}}+(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?"
#: Words that occur inside identifiers, file names and placeholders rather than in random keys.
DICTIONARY = (
    "access account action address admin alert alpha api app array auth base beta block build button cache case change check class client "
    "cloud code color column common config content control count create data date debug default delete demo detail dev document domain "
    "download dummy element email error event example factory false field file filter form format function get group handler header hello "
    "here home host http image index info input insert item java json key label length library link list load local log login main manager "
    "map message method mock model module name native network node null number object open option order page param parent password path "
    "placeholder point post private process product profile project property public query read record redirect release replace request "
    "response result return root rule sample schema script search secret select send server service session set setting size sort source "
    "start state status string style submit system table tag target task temp template test text time title token true type update upload "
    "url user util value version view web widget window world write your"
).split()
FEATURES = ("length", "letters", "digits", "upper", "marks", "transitions", "distinct", "longest_run", "hex", "dictionary", "known_prefix", "cued", "checksum", "odd_path", "assigned", "dashes")
_CUE = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|credential|bearer|private.?key|client.?key)"
_SUM = r"(?i)\b(sha-?[0-9]*|md5|hash|commit|checksum|digest|etag|uuid|guid|integrity|revision|fingerprint|blob|tree)\b"
_PATH = r"(?i)(test|spec|mock|fixture|example|sample|lock|vendor|node_modules|\.min\.|docs?/)"
_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abpr]-|sk_live_|rk_live_|AIza|glpat-|eyJ)"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``(doc_id, word_at, value, before, after, word, path, ahead)``, one row per candidate; null texts have none.

    ``word`` is the run with what stands between it and its neighbours, and the run before: all of a word
    with one run. ``ahead`` is its part before the run. Long words without white space so stay linear.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    d = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE + "+", -1).alias("w"))
    long_ones = F.expr(f"filter(sequence(0, size(w) - 1), i -> length(w[i]) >= {MIN_CHARS} AND w[i] rlike '{_KEY}{{{MIN_CHARS},}}')")
    # the outer form: a filter on the array would be pushed down and split the text again for every word
    d = d.withColumn("at", long_ones).withColumn("word_at", F.explode_outer("at")).where("word_at IS NOT NULL")
    around = lambda k: F.coalesce(F.expr(f"get(w, word_at + ({k}))"), F.lit(""))
    d = d.withColumn("word", around(0)).withColumn("before", F.concat_ws(" ", around(-3), around(-2), around(-1))).withColumn("after", around(1))
    d = d.select("doc_id", "path", "word_at", "before", "after", F.regexp_extract_all("word", F.lit(f"({_RUN})"), 1).alias("runs"), F.split("word", _RUN, -1).alias("gaps"))
    d = d.select("*", F.posexplode_outer("runs").alias("k", "value")).where("value IS NOT NULL")
    part = lambda a, k: F.coalesce(F.expr(f"get({a}, k + ({k}))"), F.lit(""))
    d = d.withColumn("ahead", F.concat(part("gaps", -1), part("runs", -1), part("gaps", 0))).withColumn("word", F.concat("ahead", "value", part("gaps", 1)))
    odd = (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")) | F.col("value").rlike(_PREFIX)
    return d.where(odd).select("doc_id", "word_at", "value", "before", "after", "word", "path", "ahead")


def features(found: DataFrame) -> DataFrame:
    """``found`` plus one double column ``s_<name>`` for each of ``FEATURES``."""
    v = F.col("value")
    n = F.length(v).cast("double")
    share = lambda p: F.regexp_count(v, F.lit(p)) / n
    turns = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    flag = lambda c: c.cast("double")
    ahead = F.col("ahead") if "ahead" in found.columns else F.regexp_extract("word", rf"^(.*?){_KEY}{{{MIN_CHARS},}}", 1)
    context = F.concat_ws(" ", "before", ahead)
    made = {
        "length": n,
        "letters": share("[A-Za-z]"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "marks": share("[^A-Za-z0-9]"),
        "transitions": F.regexp_count(v, F.lit(turns)) / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(v, F.lit(r"([a-z]+|[A-Z]+|[0-9]+)"), 1), F.length)), F.lit(0)) / n,
        "hex": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "dictionary": (n - F.length(F.regexp_replace(F.lower(v), "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")", ""))) / n,
        "known_prefix": flag(v.rlike(_PREFIX)),
        "cued": flag(context.rlike(_CUE)),
        "checksum": flag(context.rlike(_SUM)),
        "odd_path": flag(F.col("path").rlike(_PATH)),
        "assigned": flag(F.col("before").rlike(r"[=:]\s*$") | F.col("word").rlike(r"[=:]")),
        "dashes": F.regexp_count(v, F.lit("[-_/]")) / n,
    }
    return found.withColumns({f"s_{k}": made[k] for k in FEATURES})


def labelled_findings(spark: SparkSession, n: int = 1500, seed: int = SEED) -> DataFrame:
    """Labelled findings made by rule: random credentials in contexts of use, and what is mistaken for them."""
    r = random.Random(seed)
    b64, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    plain = lambda: r.choice(["the", "and of", "que la", "der", "see", "use this", "in", "value", "line"])
    cue = lambda: r.choice(["token =", "secret =", "api_key =", "password:", "auth token:", "TOKEN =", "access_key =", "client_secret:", "Bearer"])
    about = lambda: r.choice(["commit", "sha256", "md5 =", "checksum:", "uuid", "hash =", "digest:", "etag:", "integrity", "revision ="])
    rows = []
    for k in range(n):
        case = k % 3
        path = r.choice(["src/app.py", "src0", "src12", "config/prod.env", "lib/main.go", ""])
        if case == 0:
            v = r.choice([some(hexa, r.choice([32, 40, 64])), some(b64, r.randint(24, 44)), some(hexa, 40).upper(), some(b64[:62], r.randint(20, 40))])
            rows.append((f"{plain()} {cue()}", v, plain(), path, 1))
        elif case == 1:
            v = r.choice(["AKIA" + some(b64[:26] + "0123456789", 16), "ghp_" + some(b64[:62], 36), "sk_live_" + some(b64[:62], 24), "AIza" + some(b64[:62], 35), "xoxb-" + some("0123456789", 12) + "-" + some(b64[:62], 24)])
            rows.append((r.choice([plain(), f"{plain()} {cue()}"]), v, plain(), path, 1))
        else:
            word = lambda: r.choice(DICTIONARY)
            kind = r.randrange(7)
            if kind == 0:
                h = some(hexa, 32)
                v, before = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", r.choice([about(), plain(), "id ="])
            elif kind == 1:
                v, before = some(hexa, r.choice([32, 40, 64])), f"{plain()} {about()}"
            elif kind == 2:
                v, before = "".join(word().title() for _ in range(r.randint(3, 5))) + str(r.randrange(100)), r.choice([plain(), cue()])
            elif kind == 3:
                v, before = "-".join(word() for _ in range(r.randint(3, 6))) + f"-{r.randrange(3000)}", plain()
            elif kind == 4:
                v, before = r.choice(["your_api_key_here_", "xxxxxxxxxxxxxxxxxxxx", "EXAMPLEKEY0000000000", "placeholder_token_0123", "0123456789abcdef0123", "aaaaaaaaaaaaaaaa1111"]) + str(r.randrange(100)), f"{plain()} {cue()}"
            elif kind == 5:
                v, before = "/".join(word() for _ in range(r.randint(3, 6))) + f"/v{r.randrange(9)}", r.choice([plain(), "url:"])
            else:
                v, before, path = "sha512-" + some(b64, 40), r.choice(["integrity", plain()]), r.choice(["package-lock.json", "tests/fixtures/a.txt", "yarn.lock"])
            rows.append((before, v, plain(), path, 0))
    made = json.dumps([{"before": a, "value": v, "word": f'"{v}"', "after": c, "path": p, "label": y} for a, v, c, p, y in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(made), "array<struct<before:string,value:string,word:string,after:string,path:string,label:int>>")))


def fit(labelled: DataFrame, seed: int = SEED, max_train: int = MAX_TRAIN) -> list:
    """The forest from at most ``max_train`` labelled findings (columns of ``candidates`` and ``label`` 0/1)."""
    names = [f"s_{f}" for f in FEATURES]
    some = labelled.where("label IN (0, 1) AND value IS NOT NULL").orderBy(F.xxhash64("value"), "value").limit(max_train)
    data = np.array(sorted(tuple(r) for r in features(some).select(*names, F.col("label").cast("double")).collect()), float).reshape(-1, len(FEATURES) + 1)
    if not len(data):
        return [0.5]
    return trees.forest(data[:, :-1], data[:, -1], TREES, DEPTH, seed)


def scan(docs: DataFrame, model: list, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """``(doc_id, word_at, n_chars, value_sha256, score, is_secret)`` plus ``value``, one row per candidate.

    ``word_at`` counts the text's white-space separated parts from 0. Null and empty texts have no rows;
    repeated rows of documents give their findings again; null ids are kept; a null path is an empty one; an
    empty table gives an empty result; very long texts and words are taken whole. Columns other than the
    three named are not read, whatever their names.
    """
    found = features(candidates(docs, id_col, text_col, path_col))
    scored = found.withColumn("score", trees.forest_column(model, [f"s_{f}" for f in FEATURES]))
    return scored.select(
        "doc_id", F.col("word_at").cast("long"), F.length("value").cast("long").alias("n_chars"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", (F.col("score") >= threshold).alias("is_secret"), "value"
    )


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()
