"""Secret scanning with a random forest over candidate strings.

Built from DataFrame functions only.  Candidates are runs of ``MIN_LENGTH`` or more key
characters with a digit or several changes of case in them, the value assigned to a key word
or quoted after it, whatever its length and characters, and the password of a URL; each
carries the words around it.  Runs of letters in one case that no key word names are
ordinary words in most texts and are not looked at.  Features are length, character
transitions, entropy, dictionary coverage, the path or source of the document, and
neighbouring words.  The dictionary is the corpus's own most widespread words
(``corpus_words``) beside a short list of words of code.  The forest is trained on the driver
from a bounded table of labelled findings and compiled to SQL conditions, so scoring runs
inside the scan and false positives never leave it as rows of their own job.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH = 12
RUN = r"[A-Za-z0-9+/_=~-]{12,}"
#: What a run must hold: a digit, or three changes from a small to a capital letter.
TELLING = r"[0-9]|(?:[a-z][A-Z][A-Za-z+/_=~-]*?){3}"
#: A run with one of these in it, used to pass documents and words without candidates quickly.
HAS_RUN = r"(?=[A-Za-z+/_=~-]{0,200}[0-9]|[A-Za-z+/_=~-]{0,200}?(?:[a-z][A-Z][A-Za-z+/_=~-]{0,200}?){3})[A-Za-z0-9+/_=~-]{12,}"
WORDS = (
    "about access account admin alpha apple assets backup banner basic beta billing block board branch build cache cancel chart class client cloud code config connect "
    "content count data date default deploy design device docs domain email engine error event example export feature field file filter final first font form format "
    "frame green group guide header home host house http image index info input item java json label large latest layout level license light link list local login "
    "main manager master media member menu message meta model module month name network node note number object order output package page panel part path phone photo "
    "place plan player point policy post press price primary print private product profile project public query quick random read record release report request reset "
    "response result review role root route sample save schema screen script search secret section secure select server service session settings share simple site size "
    "small source space stage standard start state static status storage store story stream string style submit support system table target task team template test "
    "text theme thing third time title token tool total track trade train type under unit update upload user utils value version video view warning water web week "
    "white window with word work world www xml year zone the and for"
).split()
KEYISH = r"(?i)(token|secret|passw|pwd|api.?key|apikey|auth|credential|bearer|private|access)"
#: A key word, the rest of its name, and the value that is assigned to it or quoted after it (group 1).
KEYED = (
    KEYISH
    + r"""[\w.-]{0,60}["'`\])]{0,3}(?:\s{0,20}(?:=>|:=|={1,3}|:)\s{0,20}(?:(?:bearer|basic)\s{1,20})?|(?<=bearer)\s{1,20}|[\s(]{1,20}(?=["'`]))"""
    + r"""("(?:[^"\\\n]++|\\.){1,1000}+"|'(?:[^'\\\n]++|\\.){1,1000}+'|`[^`\n]++`|[^\s"'`]++)"""
).replace("(token", "(?:token", 1)
#: The password of scheme://user:password@host (group 1).
LOGIN = r"://[^\s/:@]*:([^\s/\"'`]+)@"
#: Words, where a key word and its value stay together.
KEYED_WORDS = rf"\S*?{KEYED}|\S+"
PLAINISH = r"(?i)(commit|sha|hash|digest|checksum|md5|uuid|guid|build|version|rev|order|invoice|phone|card|isbn|id)"
NAMES = ("length", "digits", "upper", "transitions", "distinct", "entropy", "hex", "symbols", "coverage", "slashes", "dashes", "path_test", "path_config", "key_word", "plain_word", "assigned", "quoted", "only_digits", "login")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, nth, value, token, before, after, path for every candidate in whole texts."""
    text = F.col(text_col)
    has = lambda c: c.rlike(HAS_RUN) | c.rlike(KEYED) | c.rlike(LOGIN)
    rows = docs.where(has(text)).select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.col(path_col) if path_col in docs.columns else F.lit(None)).cast("string").alias("path"),
        F.when(text.rlike(KEYED), F.regexp_extract_all(text, F.lit(KEYED_WORDS), F.lit(0))).otherwise(F.split(text, r"\s+")).alias("w"),
    )
    spots = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: has(F.get("w", i)))
    at = F.transform(
        spots,
        lambda i: F.struct(
            F.get("w", i).alias("token"),
            F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).alias("before"),
            F.coalesce(F.get("w", i + 1), F.lit("")).alias("after"),
        ),
    )
    found = rows.select("doc_id", "path", F.posexplode(at).alias("spot", "s"))
    runs = F.filter(F.regexp_extract_all("s.token", F.lit(RUN), F.lit(0)), lambda v: v.rlike(TELLING))
    bare = lambda v: F.regexp_replace(v, r"""^["'`]|["'`]$|[,;)\]}]+$""", "")
    named = F.concat(F.transform(F.regexp_extract_all("s.token", F.lit(KEYED), F.lit(1)), bare), F.regexp_extract_all("s.token", F.lit(LOGIN), F.lit(1)))
    more = F.array_except(F.filter(named, lambda v: v != ""), runs)
    each = found.select("doc_id", "path", "spot", "s.*", F.posexplode(F.concat(runs, more)).alias("part", "value"))
    nth = F.shiftleft(F.col("spot").cast("long"), 32) + F.col("part")
    return each.select("doc_id", nth.alias("nth"), "value", "token", "before", "after", "path")


def corpus_words(docs: DataFrame, most: int = 300, text_col: str = "text") -> list[str]:
    """The words of 4 to 12 letters a-z that stand in the most documents; ties by the alphabet.

    Counts cover every document; only the ``most`` leaders reach the driver.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("(?<![a-z])[a-z]{4,12}(?![a-z])"), F.lit(0)))
    leaders = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in leaders.collect()]


def features(value: Column, token: Column, before: Column, path: Column, dictionary: list[str] = ()) -> dict[str, Column]:
    """The columns of ``NAMES``; ``dictionary``: words beside ``WORDS`` that count as coverage."""
    n = F.char_length(value).cast("double")
    count = lambda pattern: (F.char_length(value) - F.char_length(F.regexp_replace(value, pattern, ""))) / n
    runs = value
    for kind, mark in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")):
        runs = F.regexp_replace(runs, kind, mark)
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    freq = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    entropy = F.aggregate(freq, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    words = "(?i)(" + "|".join(sorted((w for w in {*WORDS, *dictionary} if len(w) > 2), key=lambda w: (-len(w), w))) + ")"
    prior = F.coalesce(before, F.lit(""))
    place = F.coalesce(path, F.lit(""))
    flag = lambda c: c.cast("double")
    cols = (
        n,
        count("[0-9]"),
        count("[A-Z]"),
        (F.char_length(runs) - 1) / F.greatest(n - 1, F.lit(1.0)),
        F.size(F.array_distinct(chars)) / n,
        entropy,
        flag(value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$")),
        count("[A-Za-z0-9]+") * -1 + 1,
        count(words),
        count("[^/]+") * -1 + 1,
        count("[^_-]+") * -1 + 1,
        flag(place.rlike("(?i)(test|example|sample|fixture|mock|doc)")),
        flag(place.rlike("(?i)(config|env|prod|secret|deploy|settings)")),
        flag(prior.rlike(KEYISH) | token.rlike(KEYISH)),
        flag(prior.rlike(PLAINISH)),
        flag(prior.rlike("[=:]$") | token.rlike(r"""[A-Za-z_]+["'`\])]*\s*[=:]""")),
        flag(token.rlike("[\"'`]")),
        flag(value.rlike("^[0-9-]+$")),
        flag(token.contains(F.concat(F.lit(":"), value, F.lit("@")))),
    )
    return dict(zip(NAMES, cols))


def sample_findings(n: int = 3000, seed: int = 7) -> list[dict]:
    """Labelled findings made up from public token shapes and from what scanners misreport."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    hexa, b64 = "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    alnum = string.ascii_letters + string.digits
    syllables = ["er", "an", "tion", "de", "st", "ou", "ing", "le", "ra", "mo", "ti", "ver", "ch", "en", "la", "th"]
    invented = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(3, 6)))
    words = lambda k: [rnd.choice(WORDS) for _ in range(k)]
    keys = ["token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "credential"]
    rows = []
    for i in range(n):
        label = i % 2
        path = rnd.choice(["src1", "src7", "app/config.env", "deploy/settings.py", "tests/fixture.json", "docs/example.md", ""])
        if label:
            value = rnd.choice([lambda: pick(hexa, rnd.choice([32, 40, 48, 64])), lambda: pick(b64, rnd.randint(24, 60)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(alnum, rnd.randint(16, 40))])()
            short = i % 5 < 2
            if short:
                value = rnd.choice([lambda: pick(string.ascii_letters, rnd.randint(8, 40)), lambda: pick(alnum + "!#$%&*.@:?", rnd.randint(6, 20)), lambda: rnd.choice(WORDS).title() + pick(string.digits, rnd.randint(0, 4)) + pick("!#$%&*.@", rnd.randint(1, 2)), lambda: invented() + pick(string.digits + "!&", rnd.randint(1, 3)), lambda: " ".join(words(4))])()
            key = rnd.choice(keys)
            before, token = rnd.choice([(f"{key} =", f'"{value}"'), (f"{invented()} {key}:", value), (f"{invented()} {invented()}", f"{key}={value}"), (f"export {key.upper()}=", value), ("Authorization: Bearer", value), (f"{key} =", f"'{value}';")])
            if short:
                before = f"{invented()} {rnd.choice(WORDS)}"
                token = rnd.choice([f'{key} = "{value}"', f"{key}: '{value}'", f'"{key}":"{value}"'] + [f"{key}={value}", f"{key}: {value}", f"{rnd.choice(WORDS)}://{invented()}:{value}@{invented()}"] * (" " not in value))
        else:
            kind = rnd.randrange(9)
            value = [
                lambda: pick(string.digits, rnd.choice([12, 13, 15, 16])),
                lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
                lambda: pick(hexa, 40),
                lambda: "/".join(words(3)) + "/" + pick(string.digits, rnd.randint(1, 4)),
                lambda: "-".join(words(3)) + "-" + pick(string.digits, 2),
                lambda: "_".join(words(2)) + pick(string.digits, 3),
                lambda: f"20{pick('012', 1)}{pick(string.digits, 1)}-0{rnd.randint(1, 9)}-{rnd.randint(10, 28)}T{rnd.randint(10, 23)}",
                lambda: invented() + invented() + pick(string.digits, rnd.randint(1, 2)),
                lambda: "0" * rnd.randint(12, 30) if rnd.random() < 0.5 else "x" * 15 + "1",
            ][kind]()
            before = {0: rnd.choice(["card number", f"{invented()} {invented()}", "order id:"]), 1: rnd.choice(["uuid =", "request id"]), 2: rnd.choice(["commit", "sha1 checksum", "in commit"]), 8: rnd.choice(["token =", "password:"])}.get(kind, rnd.choice([f"{invented()} {invented()}", "see file", "version ="]))
            token = value if rnd.random() < 0.7 else f'"{value}"'
            if i % 5 < 2:
                value = rnd.choice([lambda: rnd.choice(["true", "false", "null", "None", "str", "string", "required", "optional", "bytes", "int", "a", "the", "is", "not"]), lambda: rnd.choice(WORDS), lambda: "_".join(words(2)), lambda: f"get_{rnd.choice(WORDS)}(", lambda: "${" + rnd.choice(WORDS).upper() + "}", lambda: f"<{'-'.join(words(2))}>", lambda: pick("0x*", 1) * rnd.randint(3, 8)])()
                before, key = f"{invented()} {rnd.choice(WORDS)}", rnd.choice(keys)
                token = rnd.choice([f"{key} = {value}", f"{key}: {value}", f"{key}={value}", f'{key} = "{value}"'])
        rows.append({"value": value, "token": token, "before": before, "path": path, "label": label})
    return rows


class Forest:
    """Gini trees on bootstrap samples with sqrt(features) tried at a split."""

    def __init__(self, trees: int = 20, depth: int = 6, least: int = 5, seed: int = 3):
        self.n_trees, self.depth, self.least, self.rng = trees, depth, least, np.random.default_rng(seed)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.trees = []
        for _ in range(self.n_trees):
            rows = self.rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], self.depth))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        share = float(y.mean())
        if depth == 0 or len(y) < 2 * self.least or share in (0.0, 1.0):
            return share
        best = None
        for f in self.rng.permutation(x.shape[1])[: max(2, round(x.shape[1] ** 0.5) + 1)]:
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            cut = (v[1:] > v[:-1]) & (n >= self.least) & (len(y) - n >= self.least)
            if not cut.any():
                continue
            left, right = s[:-1], s[-1] - s[:-1]
            m = len(y) - n
            gini = np.where(cut, left * (n - left) / n + right * (m - right) / m, np.inf)
            k = int(gini.argmin())
            if best is None or gini[k] < best[0]:
                best = (gini[k], int(f), float((v[k] + v[k + 1]) / 2))
        if best is None:
            return share
        go = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[go], y[go], depth - 1), self._grow(x[~go], y[~go], depth - 1)

    def prob(self, x: np.ndarray) -> np.ndarray:
        def one(tree, row):
            while not isinstance(tree, float):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        return np.array([sum(one(t, r) for t in self.trees) / len(self.trees) for r in x])

    def column(self, names: list[str]) -> Column:
        """The mean of all trees as one SQL condition tree each."""

        def sql(tree) -> str:
            if isinstance(tree, float):
                return f"{tree!r}D"
            return f"IF({names[tree[0]]} <= {tree[1]!r}D, {sql(tree[2])}, {sql(tree[3])})"

        return sum((F.expr(sql(t)) for t in self.trees[1:]), F.expr(sql(self.trees[0]))) / len(self.trees)


def train(spark: SparkSession, findings: list[dict] | DataFrame | None = None, max_findings: int = 5000, dictionary: list[str] = (), **options) -> Forest:
    """From at most ``max_findings`` labelled findings (value, token, before, path, label).

    A table of more is drawn from by hash of the value; without any, made-up ones serve.
    """
    if isinstance(findings, DataFrame):
        table = findings.select("value", "token", "before", "path", F.col("label").cast("int").alias("label")).dropna(subset=["value", "token", "label"])
        table = table.orderBy(F.xxhash64("value", "token", "before"), "value", "token", "before", "path", "label").limit(max_findings)
    else:
        from plumbline.llm.shared import inline_rows

        rows = (findings or sample_findings())[:max_findings]
        table = inline_rows(spark, rows, "value string, token string, before string, path string, label int")
    wide = F.array(*features(F.col("value"), F.col("token"), F.col("before"), F.col("path"), dictionary).values())
    got = sorted(tuple([r["label"], *r["x"]]) for r in table.select("label", wide.alias("x")).collect())
    grid = np.array(got, float).reshape(len(got), 1 + len(NAMES))
    forest = Forest(**options).fit(grid[:, 1:], grid[:, 0])
    forest.dictionary = list(dictionary)
    return forest


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, nth (order in the document), value, score, is_secret for every candidate.

    Null and empty texts have no candidates; a null or absent path is an empty one; rows
    that repeat are scanned each.
    """
    found = candidates(docs, id_col, text_col, path_col)
    feats = features(F.col("value"), F.col("token"), F.col("before"), F.col("path"), forest.dictionary)
    wide = found.withColumns({f"_{k}": v for k, v in feats.items()})
    scored = wide.withColumn("score", forest.column([f"_{k}" for k in NAMES]))
    return scored.select("doc_id", "nth", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def without_secrets(docs: DataFrame, forest: Forest, threshold: float = 0.5, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, text_hash and the text with every found secret replaced, for rows that hold one."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"), (F.col(path_col) if path_col in docs.columns else F.lit(None)).alias("path"))
    bad = scan(keyed, forest, threshold, path_col="path").where("is_secret").groupBy("doc_id").agg(F.collect_set("value").alias("values"))
    longest_first = F.array_sort("values", lambda a, b: F.length(b) - F.length(a))
    hidden = F.aggregate(longest_first, F.col("text"), lambda t, v: F.replace(t, v, F.lit(mask)))
    return keyed.join(bad, "doc_id").select("doc_id", "text_hash", hidden.alias("text"))
