"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame operations alone.

The forest is trained in numpy on labelled findings and then written as a SQL expression; features and scores of a
text's candidates are array expressions over its own row, so neither scanning nor redaction shuffles anything.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that announce a secret, and the shapes of candidates.
NAMED = r"(?i:api[_-]?key|access[_-]?key|password|passwd|pwd|secret|token|credential)s?"
RUN = r"A-Za-z0-9_+/.~-"
NAME = rf"{NAMED}[\"']?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}[\"']?"
ASSIGNED = rf"{NAME}[^\s\"'<>]{{8,}}+"
TOKEN = rf"(?<![{RUN}])(?=[A-Za-z_+/.~-]*+[0-9])[{RUN}]{{16,}}+={{0,2}}"
PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
#: A match is what lies before a candidate and the candidate; matches follow each other from the start of the text (\G keeps a
#: search that fails from being begun again at every later place).
BEARER = rf"(?<=\b[Bb]earer )[{RUN}]{{12,}}+={{0,2}}"
CANDIDATE = rf"(?:{PEM}|{ASSIGNED}|{TOKEN}|{BEARER})"
MATCH = rf"(?s)\G.*?({CANDIDATE})"
#: What of a candidate is the secret: all but the name that it is assigned to.
VALUE = rf"(?s)^(?:{NAME})?(.*)$"
#: Code points before a candidate whose words count.
NEAR = 40

#: Words of paths, code and addresses. With the words that a corpus says most often they are the dictionary
#: whose letters count as text inside a candidate.
WORDS = (
    "about", "admin", "alpha", "and", "application", "archive", "article", "asset", "author", "beta", "blog", "book",
    "build", "cache", "category", "change", "check", "class", "client", "com", "commit", "config", "content", "core",
    "css", "dash", "data", "date", "default", "demo", "dev", "docs", "document", "download", "dummy", "edit", "en",
    "example", "ex", "feature", "file", "for", "from", "function", "gallery", "get", "guide", "home", "html", "http",
    "https", "image", "index", "info", "insert", "item", "javascript", "js", "json", "key", "lang", "library", "list",
    "local", "login", "mail", "main", "manual", "master", "media", "model", "module", "net", "new", "news", "node",
    "object", "old", "online", "order", "org", "page", "password", "path", "photo", "placeholder", "plugin", "pdf",
    "png", "post", "product", "project", "public", "query", "read", "release", "report", "request", "resource",
    "sample", "script", "search", "secret", "section", "server", "service", "site", "source", "static", "style",
    "system", "table", "tag", "temp", "test", "text", "the", "theme", "this", "title", "token", "topic", "update",
    "upload", "user", "value", "version", "video", "view", "web", "wiki", "with", "www", "xml", "your",
)
#: Words before a candidate that speak for a secret, and such that speak against one.
FOR = r"(?i)(api|access|auth|bearer|cred|key|pass|priv|pwd|secret|sign|token)"
AGAINST = r"(?i)(account|blob|card|checksum|commit|digest|etag|fax|hash|id\b|invoice|isbn|md5|order|phone|revision|serial|sha\d|tracking|uuid|version|example|sample|placeholder)"
#: Heads of well-known kinds of secrets.
KNOWN = r"^(?:AKIA[0-9A-Z]{12}|gh[oprsu]_|xox[abprs]-|sk[_-]|pk_live|AIza|eyJ|glpat-|-----BEGIN)"

#: Names of the features, in the order in which forests number them.
FEATURES = ("length", "runs", "digits", "uppers", "symbols", "variety", "hex", "covered", "slashes", "dots", "in_path", "words_for", "words_against", "quoted", "assigned", "known")


def _candidates(text: str = "text") -> str:
    """SQL: the candidates of a text, with where each starts, its own text and what stands just before."""
    matches = f"case when {text} rlike {_quoted(CANDIDATE)} then regexp_extract_all({text}, {_quoted(MATCH)}, 0) else array() end"
    cut = f"transform({matches}, m -> named_struct('m', m, 'value', regexp_extract(regexp_extract(m, {_quoted(MATCH)}, 1), {_quoted(VALUE)}, 1), 'n', cast(char_length(m) as bigint)))"
    ends = "aggregate(c, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x.n)))"
    found = f"""transform(c, (x, i) -> named_struct(
        'start', e[i + 1] - char_length(x.value), 'length', cast(char_length(x.value) as bigint), 'value', x.value,
        'near', right(substring(x.m, 1, cast(x.n - char_length(x.value) as int)), {NEAR})))"""
    # Each part is computed once: an array of one holds it, and the next reads it from there.
    return f"flatten(transform(array({cut}), c -> flatten(transform(array({ends}), e -> {found}))))"


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _features(x: str, words: tuple[str, ...]) -> str:
    """SQL: the struct of features of a candidate x, all double; words are the dictionary."""
    v, near, n = f"{x}.value", f"{x}.near", f"cast({x}.length as double)"
    share = lambda pattern: f"regexp_count({v}, {_quoted(pattern)}) / {n}"
    parts = {
        "length": f"least({n}, 200D)",
        "runs": f"(regexp_count({v}, r'[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+') - 1) / {n}",
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share("[^A-Za-z0-9]"),
        "variety": f"size(array_distinct(split({v}, ''))) / least({n}, 200D)",
        "hex": f"case when {v} rlike r'^[0-9a-fA-F-]+$' then 1 else 0 end",
        "covered": f"1 - char_length(regexp_replace({v}, {_quoted('(?i)(' + '|'.join(sorted(words, key=lambda w: (-len(w), w))) + ')')}, '')) / {n}",
        "slashes": f"least(regexp_count({v}, '/'), 10)",
        "dots": f"least(regexp_count({v}, r'[.]'), 10)",
        "in_path": f"case when {near} rlike r'(://|www[.]|[/=?&#~])[^ ]*$' and not {near} rlike r'[ \"=:]$' then 1 else 0 end + case when {v} rlike r'[.][a-z]{{2,4}}$|^[/.~]' then 1 else 0 end",
        "words_for": f"regexp_count({near}, {_quoted(FOR)})",
        "words_against": f"regexp_count({near}, {_quoted(AGAINST)})",
        "quoted": f"case when {near} rlike r'[\"\\x27]$' then 1 else 0 end",
        "assigned": f"case when {near} rlike r'[:=>][ \"\\x27]*$' then 1 else 0 end",
        "known": f"case when {v} rlike {_quoted(KNOWN)} then 1 else 0 end",
    }
    return "named_struct(" + ", ".join(f"'{k}', cast({parts[k]} as double)" for k in FEATURES) + ")"


# The forest. A tree is a leaf (share of secrets) or (feature, cut, tree at most cut, tree above).


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, leaf: int):
    if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
        return float(y.mean())
    best = (1e-9, 0, 0.0)
    whole = y.mean() * (1 - y.mean())
    for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        left = np.arange(1, len(y))
        p, q = ones[:-1] / left, (ones[-1] - ones[:-1]) / (len(y) - left)
        gain = whole - (left * p * (1 - p) + (len(y) - left) * q * (1 - q)) / len(y)
        gain[(v[1:] == v[:-1]) | (left < leaf) | (len(y) - left < leaf)] = 0
        if (at := int(gain.argmax())) >= 0 and gain[at] > best[0]:
            best = (gain[at], int(f), float((v[at] + v[at + 1]) / 2))
    gain, f, cut = best
    if gain <= 1e-9:
        return float(y.mean())
    low = x[:, f] <= cut
    return f, cut, _grow(x[low], y[low], rng, depth - 1, leaf), _grow(x[~low], y[~low], rng, depth - 1, leaf)


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 6, leaf: int = 3, seed: int = 5) -> list:
    """Trees on bootstrap samples, each split on a few features drawn anew."""
    rng, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(_grow(x[rows], y[rows].astype(float), rng, depth, leaf))
    return forest


def predict(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _tree_sql(tree, f: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    at, cut, low, high = tree
    return f"case when {f}.{FEATURES[at]} <= {cut!r}D then {_tree_sql(low, f)} else {_tree_sql(high, f)} end"


def forest_sql(forest: list | tuple, f: str) -> str:
    """SQL: the mean of the trees over the struct of features f."""
    return "(" + " + ".join(_tree_sql(t, f) for t in forest) + f") / {len(forest)}D"


# Labelled findings.


def labelled_findings(rows: int = 2_400, seed: int = 3, without: int | None = None, only: int | None = None) -> list[tuple[str, str, int]]:
    """(candidate, text before it, 1 if a secret), made by rule: keys, tokens and passwords where code and notes have
    them, against digests, ids, numbers, addresses, paths, versions and placeholders. Kinds are numbered, secrets first:
    one can be left out, or be the only one, to see how a forest does on kinds that it was not shown."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    hexed, lower, upper, digits = "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase, string.digits
    mixed = lower + upper + digits
    prose = lambda: " ".join(chars(lower, int(rng.integers(2, 9))) for _ in range(int(rng.integers(0, 6))))
    join = lambda: pick((" = \"", "=", ": ", ": \"", " = '", "=\"", ":", " => \"", " = "))
    name = lambda: pick(("token", "api_key", "apikey", "secret", "password", "access_key", "auth_token", "client_secret", "API_TOKEN", "Secret", "db_password", "private key"))
    words = lambda n: pick(("-", "_", "/", ".")).join(pick(WORDS) for _ in range(n))
    secrets = (
        lambda: (chars(hexed, pick((32, 40, 64))), f"{name()}{join()}"),
        lambda: (chars(hexed, pick((32, 40, 64))), f"{name()}{join()}"),
        lambda: (chars(mixed, int(rng.integers(20, 64))), f"{name()}{join()}"),
        lambda: (chars(mixed + "+/", pick((32, 40, 43))) + pick(("", "=")), f"{name()}{join()}"),
        lambda: ("AKIA" + chars(upper + digits, 16), pick(("", "aws key ", "access_key=", "id: "))),
        lambda: (pick(("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "sk-")) + chars(mixed, int(rng.integers(20, 40))), pick(("", f"{name()}{join()}", "Bearer ", "use "))),
        lambda: ("eyJ" + chars(mixed + "-_", 30) + ".eyJ" + chars(mixed + "-_", 60) + "." + chars(mixed + "-_", 43), pick(("Authorization: Bearer ", "jwt=", "", "token: "))),
        lambda: (chars(mixed, int(rng.integers(16, 48))), pick(("Authorization: Bearer ", "Bearer ", "X-Auth-Key: ", "--password=", "-p "))),
        lambda: (chars(lower, int(rng.integers(4, 9))).title() + chars(digits + "!@#$%", int(rng.integers(3, 6))), f"{pick(('password', 'passwd', 'pwd', 'db_password'))}{join()}"),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + chars(mixed + "+/", 64) + "\n-----END RSA PRIVATE KEY-----", ""),
    )
    others = (
        lambda: (chars(hexed, pick((32, 40, 64))), pick(("commit ", "sha256: ", "md5 ", "checksum = ", "sha1:", "digest: ", "revision ", "etag: \""))),
        lambda: (chars(hexed, pick((32, 40, 64))), prose() + " "),
        lambda: ("-".join(chars(hexed, n) for n in (8, 4, 4, 4, 12)), pick(("uuid: ", "id=", "", "request id "))),
        lambda: (chars(digits, pick((16, 16, 17, 18, 20))), pick(("", "card ", "account: ", "order ", "isbn ", "tracking number: ", "in ", "the "))),
        lambda: (chars(digits, pick((16, 16, 19))), prose() + " "),
        lambda: (f"{chars(lower, 4)}{chars(digits, 2)}.{pick(('example', 'mail', 'site'))}.{pick(('com', 'org', 'net'))}", pick(("@", "user@", "mail ", "www.", ""))),
        lambda: (f"//{pick(('www', 'blog', 'docs', 'cdn'))}.{chars(lower, 6)}.{pick(('com', 'net', 'org'))}/{words(3)}/{chars(digits, 5)}", pick(("https:", "http:"))),
        lambda: (f"/{words(3)}/{chars(lower, 4)}{chars(digits, 3)}.{pick(('png', 'html', 'pdf', 'js'))}", pick(("", "href=", "src=\"", "see "))),
        lambda: (f"{words(3)}-{chars(digits, 2)}.{chars(digits, 1)}.{chars(digits, 2)}", pick(("version ", "", "release ", "file "))),
        lambda: (f"20{chars(digits, 2)}-{chars(digits, 2)}-{chars(digits, 2)}T{chars(digits, 6)}", pick(("date: ", "on ", ""))),
        lambda: (f"{words(2)}{chars(digits, 2)}", prose() + " "),
        lambda: (pick(("your_token_here1", "example-key-123456", "placeholder_value", "changeme12345678", "insert-password-1", "xxxxxxxxxxxxxxxx1", "test_token_000000", "<your-api-key-1>".strip("<>"))), f"{name()}{join()}"),
        lambda: (f"{words(2)}_{chars(digits, 1)}", f"{name()}{join()}"),
        lambda: ("+" + chars(digits, 2) + "-" + chars(digits, 3) + "-555-" + chars(digits, 6), pick(("phone ", "call ", "fax: ", ""))),
        lambda: (chars(lower + upper, int(rng.integers(14, 30))) + chars(digits, 1), prose() + " "),
    )
    kinds = [(1, k) for k in secrets] + [(0, k) for k in others]
    chosen = [k for i, k in enumerate(kinds) if i != without and (only is None or i == only)]
    out = []
    for i in range(rows):
        own = [k for label, k in chosen if only is not None or label == i % 2]
        label = i % 2 if only is None else chosen[0][0]
        value, before = pick(own)()
        out.append((value, (prose() + pick((" ", "\n", "  ")) + before)[-NEAR:], label))
    return out


def findings_table(spark: SparkSession, findings: list[tuple[str, str, int]]) -> DataFrame:
    """Labelled findings as a table of value, near and label, without a Python task."""
    rows = json.dumps([{"value": v, "near": n, "label": k} for v, n, k in findings])
    parsed = F.from_json(F.lit(rows), "array<struct<value:string,near:string,label:int>>")
    return spark.range(1).select(F.explode(parsed).alias("r")).select("r.*")


@dataclass(frozen=True)
class Forest:
    """Trees over the features of candidates, and the dictionary that one of the features is by."""

    trees: tuple
    words: tuple[str, ...] = WORDS


def learn_words(docs: DataFrame, most: int = 400, shortest: int = 4, longest: int = 12) -> tuple[str, ...]:
    """The words of `shortest` to `longest` letters a to z that most documents say, `most` of them, ties by word.

    Every document is counted, a word once in each; tasks add up before they shuffle, a row a word. Null and empty texts
    say none.
    """
    own = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![a-z])[a-z]{{{shortest},{longest}}}(?![a-z])"), F.lit(0)))).alias("word"))
    found = own.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()
    return tuple(r["word"] for r in found)


def train(findings: DataFrame, words: tuple[str, ...] = WORDS, most: int = 10_000, trees: int = 24, seed: int = 5) -> Forest:
    """A forest from labelled findings (value, near, label 0 or 1), of which at most `most`, by hash, are used.

    Rows with a null or empty value or a null label teach nothing; near may be null. Without rows of both labels all
    candidates are taken for secrets.
    """
    usable = findings.filter((F.length("value") > 0) & F.col("label").isin(0, 1)).select("value", F.coalesce("near", F.lit("")).alias("near"), "label")
    usable = usable.orderBy(F.xxhash64("value", "near"), "value", "near", "label").limit(most)
    found = usable.select(F.struct("value", "near", F.length("value").cast("long").alias("length")).alias("x"), "label").select(F.expr(_features("x", words)).alias("f"), "label").collect()
    x = np.array([[r["f"][k] for k in FEATURES] for r in found], float).reshape(-1, len(FEATURES))
    y = np.array([r["label"] for r in found])
    return Forest(tuple(grow_forest(x, y, trees, seed=seed)) if len(set(y.tolist())) == 2 else (1.0,), words)


def findings(forest: Forest, text: str = "text") -> Column:
    """array<struct<start, length, value, near, score>>: the candidates of a text and the forest's score of each."""
    features = f"transform({_candidates(text)}, x -> named_struct('x', x, 'f', {_features('x', forest.words)}))"
    scored = f"transform({features}, c -> named_struct('start', c.x.start, 'length', c.x.length, 'value', c.x.value, 'near', c.x.near, 'score', {forest_sql(forest.trees, 'c.f')}))"
    return F.expr(scored)


def scan(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """The secrets of whole texts, a row a secret.

    docs: doc_id, text; other columns are ignored. Candidates are private keys, values assigned to a name such as
    `token`, runs of 16 or more characters with a digit, and such of 12 after `Bearer`; they don't overlap. Those that the forest scores under least
    are taken for false positives. Null and empty texts have none; rows that repeat are scanned each; an empty table
    gives no rows. Returns doc_id, start (code points before it), length, score, secret_sha256.
    """
    found = docs.select("doc_id", F.explode(F.filter(findings(forest), lambda x: x["score"] >= least)).alias("s"))
    return found.select("doc_id", "s.start", "s.length", "s.score", F.sha2("s.value", 256).alias("secret_sha256"))


def redact(docs: DataFrame, forest: Forest, least: float = 0.5, mark: str = "[REDACTED_SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark; the columns are those of docs, n_chars, if there, follows the text."""
    own = F.filter(findings(forest), lambda x: x["score"] >= least)
    spans = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), docs["text"].alias("text"), own.alias("spans"))
    # The text is put together from what lies between secrets: each starts where the one before it ends.
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["start"] + s["length"]))
    between = F.zip_with("spans", F.slice(ends, 1, F.size("spans")), lambda s, b: F.concat(F.col("text").substr((b + 1).cast("int"), (s["start"] - b).cast("int")), F.lit(mark)))
    last = F.element_at("spans", -1)
    tail = F.col("text").substr((last["start"] + last["length"] + 1).cast("int"), F.length("text"))
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(between, ""), tail)).otherwise(F.col("text"))
    cleaned = spans.select("whole", text.alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return cleaned.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])


def default_forest(spark: SparkSession, docs: DataFrame) -> Forest:
    """A forest from the findings that are labelled by rule, with a dictionary of our own words and those of docs."""
    return train(findings_table(spark, labelled_findings()), tuple(sorted({*WORDS, *learn_words(docs)})))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, default_forest(spark, docs))
