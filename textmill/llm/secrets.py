"""Secret scans: candidate strings by pattern, false positives by a forest.

Everything that touches rows is a DataFrame expression; no Python runs on the
executors.  Candidates are long runs of token characters that hold a digit, and
quoted or bare values after a credential's name.  Each is described by its length,
character transitions, dictionary coverage, the path of its row and its
neighbouring words.  A random forest, grown on the driver from labelled
findings (texts with one reviewed finding each), is turned into one
expression; candidates below the threshold are false positives.

Null texts have no candidates and stay null, empty texts have none, equal
findings in a text are counted each, null ids and repeated rows are rows like
others, columns may have any names, a null path is no path, an empty table
gives an empty result.  Offsets are characters from 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.storage import once

#: Characters on each side of a candidate that count as its neighbourhood.
NEAR = 48
#: Names that introduce a credential (fixed list).
NAMES = "token|secret|password|passwd|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential|private[_-]?key|bearer"
#: Names that introduce a harmless long string (fixed list).
HARMLESS = "commit|sha1|sha256|md5|hash|checksum|digest|uuid|guid|revision|etag|integrity|example|sample|placeholder|dummy|id"
#: Words and word pieces that credentials don't hold (fixed list).
DICTIONARY = "example|sample|placeholder|dummy|test|your|token|secret|password|changeme|here|insert|replace|value|version|build|release|image|width|height|border|color|style|table|index|page|chapter|section|figure|number|data|file|name|user|http|www|html|tion|ing|ment|able|ible|lich|keit|heit|ung|schen|eau|eux|elle|ción|ado|rre|the|and|ent|ion|ere|oth|ith|ost|out"
RUN = "[A-Za-z0-9_+/=-]"
#: Names before a quote or a sign (those of NAMES that introduce a value).
CREDENTIAL = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|credential"
VALUE = r"[^\s\"'<>,;(){}\[\]]"
#: One pattern, so that a text is read once.  A run that isn't part of a longer
#: one and holds a digit, unless it begins with a name and "=";
_LONG = rf"(?<!{RUN})(?=[A-Za-z_+/=-]*+[0-9])(?![\w-]{{0,40}}?(?i:{CREDENTIAL})=){RUN}{{16,}}+"
#: a quoted value after a name and up to eight signs or blanks;
_QUOTED = rf"(?<=[\"'])(?i:(?<=(?:{CREDENTIAL})[\"']?[^\w\r\n\"']{{1,8}}[\"'])[^\s\"']{{8,}}+(?=[\"']))"
#: a bare value after a name and "=", ":", ":=" or "=>", with a digit or a sign
#: or sixteen letters, so that no plain word of a sentence is one.
_BARE = rf"(?<=[=:>][ \t]{{0,3}})(?i:(?<=(?:{CREDENTIAL})[\"']?[ \t]{{0,3}}(?::=|=>|[=:])[ \t]{{0,3}}))(?=[A-Za-z]{{16}}|{VALUE}*?[0-9!#$%&*@^~])(?![=:]){VALUE}{{8,}}+"
CANDIDATE = f"{_LONG}|{_QUOTED}|{_BARE}"
FEATURES = ("length", "moves", "distinct", "digits", "upper", "hex", "covered", "named", "assigned", "quoted", "harmless", "dashed", "pathlike", "testpath", "only_digits")
FINDINGS = 4000


def _found(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(row: the whole row, t: its text, found: an array of start, value and
    features of its candidates).  No join, and names of its own only."""
    pattern = F.lit(f"(?s)\\G(.*?)({CANDIDATE})")
    none = F.lit(None).cast("array<string>")
    row = F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row")
    where = docs[f"`{path}`"].cast("string") if path else F.lit(None).cast("string")
    base = docs.select(row, docs[f"`{text}`"].alias("t"), where.alias("path"))
    has = F.col("t").rlike(CANDIDATE)
    # what stands before each candidate, and the candidate: their lengths give
    # the offsets
    base = once(base, gap=F.when(has, F.regexp_extract_all("t", pattern, F.lit(1))).otherwise(none), value=F.when(has, F.regexp_extract_all("t", pattern, F.lit(2))).otherwise(none))
    steps = F.expr("aggregate(arrays_zip(gap, value), named_struct('at', 0, 'all', cast(array() as array<struct<start:int,value:string>>)), (a, x) -> named_struct('at', a.at + length(x.gap) + length(x.value), 'all', concat(a.all, array(named_struct('start', a.at + length(x.gap), 'value', x.value)))), a -> a.all)")
    at = once(base, at=F.when(F.col("value").isNotNull(), steps))
    near = F.transform("at", lambda x: F.struct(x["start"].alias("start"), x["value"].alias("value"), F.expr("t").substr(F.greatest(F.lit(1), x["start"] + 1 - NEAR), F.least(F.lit(NEAR), x["start"])).alias("before"), F.expr("t").substr(x["start"] + 1 + F.length(x["value"]), F.lit(NEAR)).alias("after")))
    near = once(at, near=near)
    found = F.transform("near", lambda x: F.struct(x["start"].alias("start"), x["value"].alias("value"), F.array(*described(x, F.col("path"))).alias("features")))
    return once(near, found=found).select("row", "t", "found")


def _scored(docs: DataFrame, forest: Forest, threshold: float, path: str | None) -> DataFrame:
    """(row, t, every: candidates with scores, secret: those above the
    threshold and others of the same value)."""
    empty = F.expr("cast(array() as array<struct<start:int,value:string,score:double>>)")
    scored = F.expr(f"transform(found, x -> named_struct('start', x.start, 'value', x.value, 'score', {forest.sql('x.features')}))")
    every = once(_found(docs, "text", path).select("row", "t", "found"), every=F.coalesce(scored, empty))
    # a value that is a secret in one place is one in all others of the text
    bad = once(every, bad=F.expr(f"array_distinct(transform(filter(every, x -> x.score >= {threshold}D), x -> x.value))"))
    secret = F.when(F.size("bad") > 0, F.expr("filter(every, x -> array_contains(bad, x.value))")).otherwise(empty)
    return once(bad, secret=secret).select("row", "t", "every", "secret")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(text, path, label): texts with one finding each, half of them real
    credentials, by rule from hashes: formats of keys and of what is taken for
    them, among made-up words and marks.  Of the false ones some look like real
    ones, as fixtures and documentation hold them: there the path tells.  A
    table of reviewed findings with these columns can be given instead."""
    h = "h{0}".format
    draw = lambda what, k: f"cast(conv(substring(sha2(concat('{what}', id), 256), 1, 6), 16, 10) as int) % {k}"
    pick = lambda what, *of: f"element_at(array({', '.join(of)}), 1 + {draw(what, len(of))})"
    quoted = lambda *of: [f"'{x}'" for x in of]
    # made-up words: letters for hex digits, three to eight of them
    word = "translate(substring({0}, {1}, cast(3 + conv(substring({0}, {1}, 1), 16, 10) % 6 as int)), '0123456789abcdef', 'aeiounrstlmdkbpg')".format
    marks = "translate(substring({0}, {1}, cast(conv(substring({0}, {1}, 1), 16, 10) % 4 as int)), '0123456789abcdef', '!#$%&*=:!#$%&*=:')".format
    hexes = lambda k, at=1: f"substring({h(1)}, {at}, {k})"
    mixed = lambda k: f"substring(mixed_all, 1, {k})"
    letters = lambda k: f"substring(translate({h(7)}, '0123456789abcdef', 'qwxzjkvbgmtplrns'), 1, {k})"
    base32 = f"substring(translate({h(3)}, '0189abcdef', 'QWZXABCDEF'), 1, 16)"
    name = pick("name", *quoted("token", "secret", "password", "api_key", "auth_token", "access_key", "apikey", "credential"))
    key = pick("key", *quoted("password", "api_key", "access_key", "DB_PASSWORD", "APP_SECRET", "passwd", "service_token"))
    sign = f"concat({pick('sign', *quoted(' =', ':', '=', ' :', ' =>'))}, {pick('gap', *quoted(' ', ''))}, {marks(h(6), 3)}, '\"')"
    bare = pick("bare", *quoted(" = ", "=", ": ", " := "))
    phrase = f"concat({word(h(8), 1)}, {pick('joint', *quoted('', '-', '_', '7', '42', '2019', '!'))}, {word(h(8), 11)}, {word(h(8), 21)})"
    common = pick("common", *quoted("summer", "secret", "admin", "welcome", "dragon", "coffee", "monkey", "letmein", "sunshine", "master"))
    # each made once, in two steps, as the formats below use them many times
    drawn = {f"h{k}": f"sha2(concat('finding', {k}, ':', id), 512)" for k in range(1, 9)}
    held = {"name": name, "key": key, "sign": sign, "bare": bare, "phrase": phrase, "common": common, "mixed_all": f"translate(base64(unhex({h(2)})), '+/=', 'xYz')"}
    name, key, sign, bare, phrase, common = "name", "key", "sign", "bare", "phrase", "common"
    real = [
        f"concat({name}, {sign}, {hexes(40)}, '\"')",
        f"concat(upper({name}), {sign}, upper({hexes(40)}), '\"')",
        f"concat({name}, ' = \"ghp_', {mixed(36)}, '\"')",
        f"concat({name}, {sign}, {mixed(32)}, '\"')",
        f"concat('key ', 'AKIA', upper({base32}), ' ')",
        f"concat({name}, {sign}, {hexes(32)}, '\"')",
        f"concat('Bearer ', {mixed(64)})",
        f"concat({name}, {sign}, {mixed(20)}, '\"')",
        f"concat({key}, {bare}, {mixed(28)})",
        f"concat({key}, {bare}, {word(h(8), 1)}, {draw('n', 9000)}, {letters(6)})",
        f"concat({key}, {bare}, {common}, {draw('n', 9000)}, {pick('end', *quoted('!', 'pw', 'abc', 'xyz', 'key', 'pass'))}, {letters(2)})",
        f"concat({key}, {pick('eq', *quoted('=', ' = ', ': '))}, '\"', {common}, {word(h(8), 1)}, {word(h(8), 11)}, '\"')",
        f"concat({key}, {bare}, {letters(24)})",
        f"concat('\"', {key}, '\": \"', {phrase}, '\"')",
        f"concat({key}, '=\"', {phrase}, {letters(5)}, '\"')",
        f"concat('live-', {draw('a', 90000)}, '-', {draw('b', 90000)}, '-', {mixed(24)})",
    ]
    false = [
        f"concat('commit ', {hexes(40)})",
        f"concat('id ', {hexes(8)}, '-', {hexes(4, 9)}, '-4', {hexes(3, 13)}, '-a', {hexes(3, 17)}, '-', {hexes(12, 21)})",
        f"concat('md5: ', {hexes(32)})",
        f"substring(translate({h(4)}, 'abcdef', '123456'), 1, 16)",
        f"concat({name}, {sign}, 'your-', {name}, '-here-123456789', '\"')",
        f"concat('https://files.example.org/data/', {hexes(32)}, '/index.html')",
        "concat('chapter-', id, '-section-', id % 7, '-figure-', id % 11, '-table')",
        "concat('build/release-2', id, '/image_width_1024_height_768')",
        f"concat('sha256 checksum ', {hexes(64)})",
        f"concat({name}, ' example_value_0000000000')",
        f"concat({key}, {bare}, {pick('shown', *quoted('********', 'xxxxxxxxxxxx', '$DB_PASSWORD', '$1', '%s-%s-%s-%s', '&placeholder', '0000000000', '#required'))}, '************')",
        f"concat('\"', {key}, '\": \"', {pick('said', *quoted('changeme', 'required', 'placeholder', 'your-value-here', 'undefined', 'test-password', 'example-token', 'xxxxxxxxxxxx'))}, '\"')",
        f"concat({key}, {bare}, {pick('where', *quoted('settings.', 'config.', 'process.env.', 'self.options.', 'os.environ.'))}, {name}, '_value2')",
        f"concat({word(h(8), 1)}, '_', {word(h(8), 11)}, '_', {word(h(8), 21)}, '_', {word(h(8), 31)}, {draw('v', 90)})",
        f"concat('\"', {pick('tag', *quoted('etag', 'revision', 'guid', 'digest', 'hash'))}, '\": \"', {pick('cut', mixed(20), mixed(40), mixed(64))}, '\"')",
    ]
    # the same formats as real ones, in fixtures
    fixtures = [real[i] for i in (0, 3, 7, 8, 9, 10)]
    arms = lambda rows, of, at=0: f"case {' '.join(f'when id div 2 % {of} = {at + i} then {x}' for i, x in enumerate(rows))} end"
    n_false = len(false) + len(fixtures)
    shown = {"real": arms(real, len(real)), "harmless": arms(false, n_false), "fixture": arms(fixtures, n_false, len(false))}
    words = lambda at: f"concat_ws(' ', {', '.join(word(h(5), at + 9 * j) for j in range(3))})"
    tests = pick("test", *quoted("tests/fixtures/a.json", "docs/readme.md", "examples/run.sh", "spec/login_test.rb", "src/test/java/A.java"))
    other = pick("other", *quoted("src/app.py", "config/site.yml", "deploy/.env", "lib/client.js"), "cast(null as string)")
    fixture = f"id % 2 = 0 and id div 2 % {n_false} >= {len(false)}"
    path = f"if({fixture} or {draw('p', 40)} < if(id % 2 = 1, 1, 12), {tests}, {other})"
    case = f"if({draw('case', 8)} = 0, upper({{0}}), {{0}})".format
    made = spark.range(n)
    for columns in (drawn, held, shown):
        made = once(made, **{k: F.expr(v) for k, v in columns.items()})
    text = f"concat({case(words(1))}, ' ', if(id % 2 = 1, real, coalesce(harmless, fixture)), ' ', {case(words(40))})"
    return once(made, text=F.expr(text), path=F.expr(path)).select("text", "path", F.expr("cast(id % 2 as int)").alias("label"))


class Forest:
    """Bagged Gini trees over the square root of the features at each node."""

    def __init__(self, trees: int = 25, depth: int = 10, seed: int = 3):
        self.n, self.depth, self.rng = trees, depth, np.random.default_rng(seed)
        self.trees: list = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.n):
            rows = self.rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], self.depth))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or y.min() == y.max() or len(y) < 6:
            return float(y.mean())
        best = None
        for f in self.rng.permutation(x.shape[1])[: int(np.ceil(np.sqrt(x.shape[1])) + 1)]:
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(at):
                continue
            left, right = c[at - 1] / at, (c[-1] - c[at - 1]) / (len(y) - at)
            cost = at * left * (1 - left) + (len(y) - at) * right * (1 - right)
            i = int(np.argmin(cost))
            if best is None or cost[i] < best[0]:
                best = cost[i], int(f), float((v[at[i]] + v[at[i] - 1]) / 2)
        if best is None:
            return float(y.mean())
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(t, r):
            while isinstance(t, tuple):
                t = t[2] if r[t[0]] <= t[1] else t[3]
            return t

        return np.array([np.mean([walk(t, r) for t in self.trees]) for r in x])

    def sql(self, column: str) -> str:
        """The mean over the trees, as SQL over an array of features: the nodes
        are arrays of constants, each tree is walked from its root, and a leaf
        leads to itself.  Its length is that of the nodes, and the generated
        code's doesn't grow with them."""
        nodes: list[list] = []

        def put(t) -> int:
            at = len(nodes)
            nodes.append([0, 0.0, at, at, t])
            if isinstance(t, tuple):
                nodes[at] = [t[0], t[1], put(t[2]), put(t[3]), 0.0]
            return at

        roots = [put(t) for t in self.trees]
        feature, bound, low, high, value = ("array(" + ", ".join(f"{float(x)!r}D" if k in (1, 4) else str(x) for x in of) + ")" for k, of in enumerate(zip(*nodes)))
        step = f"if({column}[{feature}[n]] <= {bound}[n], {low}[n], {high}[n])"
        walk = f"aggregate(sequence(1, {self.depth}), r, (n, i) -> {step}, n -> {value}[n])"
        return f"aggregate(array({', '.join(map(str, roots))}), 0D, (s, r) -> s + {walk}) / {len(self.trees)}D"


def fit_forest(labelled: DataFrame, most: int = 20_000, **kw) -> Forest:
    """From at most ``most`` labelled findings (a documented bound, the
    smallest hashes of the text first); a text's findings all have its label."""
    own = _found(labelled, path="path").select("row.label", "t", F.explode("found").alias("x")).orderBy(F.xxhash64("t"), "t", "x.start", "label").limit(most)
    rows = sorted((tuple(r.features), r.label) for r in own.select("x.features", "label").collect())
    return Forest(**kw).fit(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float))


def evaluate(labelled: DataFrame, apart: int = 4, threshold: float = 0.5, **kw) -> dict[str, float]:
    """Precision and recall of findings whose texts' hash leaves 0 of
    ``apart``, with a forest of the others."""
    test = F.pmod(F.xxhash64("text"), F.lit(apart)) == 0
    forest = fit_forest(labelled.filter(~test), **kw)
    bad = F.size("secret") > 0
    got = _scored(labelled.filter(test), forest, threshold, "path").agg(*[F.count_if(c & (F.col("row.label") == k)).alias(n) for n, c, k in (("tp", bad, 1), ("fp", bad, 0), ("fn", ~bad, 1), ("tn", ~bad, 0))]).first()
    return {"precision": got.tp / max(1, got.tp + got.fp), "recall": got.tp / max(1, got.tp + got.fn), "findings": got.tp + got.fp + got.fn + got.tn}


def scan(docs: DataFrame, forest: Forest, key: str = "doc_id", path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: key, start, value, score, is_secret."""
    found = _found(docs, path=path).select(F.col(f"row.`{key}`").alias(key), F.explode("found").alias("x"))
    return found.select(key, "x.start", "x.value", F.expr(forest.sql("x.features")).alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def scan_report(docs: DataFrame, forest: Forest, path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs``: its candidates, secrets with spans, and the text's
    digest after redaction.  No join: findings stay in an array."""
    return _scored(docs.select("doc_id", "text", *([path] if path else [])), forest, threshold, path).select(
        "row.doc_id", F.size("every").cast("long").alias("n_candidates"), F.size("secret").cast("long").alias("n_secrets"),
        F.expr("transform(secret, x -> named_struct('start', cast(x.start as long), 'end', cast(x.start + length(x.value) as long), 'score', x.score, 'value_sha256', sha2(x.value, 256)))").alias("secrets"),
        F.sha2(_redacted(), 256).alias("redacted_sha256"),
    )


def redact(docs: DataFrame, forest: Forest, path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``<secret>`` for each secret; other columns as they are,
    n_chars (if there) counted anew."""
    found = once(_scored(docs, forest, threshold, path), new=_redacted())
    new = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in new:
        new["n_chars"] = F.when(F.size("secret") > 0, F.length("new").cast("long")).otherwise(new["n_chars"])
    return found.select(*[c.alias(k) for k, c in new.items()])


def _redacted() -> Column:
    """The text with each span of ``secret`` replaced; where a short value
    stands as a plain word or in one, it stays."""
    step = "named_struct('at', x.start + length(x.value), 'out', concat(a.out, substring(t, a.at + 1, x.start - a.at), '<secret>'))"
    return F.expr(f"case when size(secret) = 0 then t else aggregate(secret, named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring(t, a.at + 1))) end")


def described(x, path: Column | None = None) -> list[Column]:
    """FEATURES as doubles, of what holds value, before and after."""
    v, b = x["value"], F.lower(x["before"])
    n = F.length(v).cast("double")
    share = lambda p: F.regexp_count(v, F.lit(p)) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        n,
        share("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"),
        F.size(F.array_distinct(F.split(v, ""))).cast("double"),
        share("[0-9]"),
        share("[A-Z]"),
        flag(v.rlike("^[0-9a-fA-F]+$")),
        1 - F.length(F.regexp_replace(F.lower(v), DICTIONARY, "")) / n,
        flag(b.rlike(rf"(?:{NAMES})[^a-z0-9]{{0,12}}$")),
        flag(b.rlike("[=:][^a-z0-9]{0,6}$")),
        flag(x["before"].rlike("[\"']$")),
        flag(b.rlike(rf"\b(?:{HARMLESS})[^a-z0-9]{{1,6}}$")),
        share("-"),
        flag(x["before"].rlike("[/\\\\.@]$|https?:[^ ]*$") | x["after"].rlike("^[./\\\\@]\\w")),
        F.lit(0.0) if path is None else flag(F.coalesce(F.lower(path), F.lit("")).rlike("test|spec|example|fixture|docs|\\.lock")),
        flag(v.rlike("^[0-9]+$")),
    ]
