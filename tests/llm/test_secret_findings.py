"""Findings that the forest wasn't trained on: other formats, by another rule."""

import random
import string

from pyspark.sql import functions as F
import pytest

from textmill.llm import secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.fit_forest(secrets.labelled_findings(spark))


def _planted(n, seed):
    """(text, path, value, label): formats that ``labelled_findings`` doesn't
    make, in sentences of plain English."""
    rng = random.Random(seed)
    of = lambda k, chars=string.ascii_letters + string.digits: "".join(rng.choice(chars) for _ in range(k))
    hexes = string.digits + "abcdef"
    real = [
        lambda: ("slack_token = '{}'", f"xoxb-{of(12, string.digits)}-{of(12, string.digits)}-{of(24)}"),
        lambda: ("export GITLAB_TOKEN=\"{}\"", f"glpat-{of(20)}"),
        lambda: ("stripe.api_key = \"{}\"", f"sk_live_{of(24)}"),
        lambda: ("client_secret: \"{}\"", f"GOCSPX-{of(28)}"),
        lambda: ("<password>{{'password': '{}'}}</password>", of(10, string.ascii_lowercase) + of(3, string.digits) + "!"),
        lambda: ("aws_secret_access_key={}", of(40, string.ascii_letters + string.digits + "/+")),
        lambda: ("\"api-key\" : \"{}\"", of(32, hexes)),
        lambda: ("MYSQL_PASSWORD: {}", of(6, string.ascii_lowercase) + of(4, string.digits) + of(6)),
    ]
    false = [
        lambda: ("see https://git.example.net/r/{}/tree", of(40, hexes)),
        lambda: ("\"integrity\": \"{}\"", f"sha512-{of(80)}"),
        lambda: ("taken at {} by the camera", f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10-2{rng.randint(0, 9)}-33-{of(3, string.digits)}"),
        lambda: ("uuid {}", "-".join(of(k, hexes) for k in (8, 4, 4, 4, 12))),
        lambda: ("call {} now", f"+49-{of(4, string.digits)}-{of(8, string.digits)}"),
        lambda: ("password: \"{}\"", rng.choice(("your_password_here", "<placeholder>", "insert-password", "example-value", "changeme"))),
        lambda: ("class {} of the page", f"column-width-{rng.randint(1, 12)}-table-row-{rng.randint(1, 9)}"),
        lambda: ("checksum {}", of(64, hexes)),
    ]
    rows = []
    for i in range(n):
        shape, value = rng.choice(real if i % 2 else false)()
        rows.append((f"We found it there and {shape.format(value)} was kept for later use.", rng.choice(("src/main.go", "app/settings.ini", None)), value, i % 2))
    return rows


def test_precision_and_recall_on_formats_not_trained_on(spark, forest):
    rows = _planted(1200, 11)
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _, _) in enumerate(rows)], "doc_id long, text string, path string")
    found = {}
    for r in secrets.scan(df, forest, path="path").filter("is_secret").collect():
        found.setdefault(r.doc_id, []).append(r.value)
    tp = sum(any(v in x or x in v for x in found.get(i, [])) for i, (_, _, v, y) in enumerate(rows) if y)
    fp = sum(i in found for i, r in enumerate(rows) if not r[3])
    real = sum(r[3] for r in rows)
    print({"recall": tp / real, "precision": tp / max(1, tp + fp), "missed": [r[0] for i, r in enumerate(rows) if r[3] and i not in found][:6], "false": [rows[i][0] for i in found if not rows[i][3]][:6]})
    assert tp / real > 0.9 and tp / (tp + fp) > 0.9


def test_the_path_decides_what_the_value_can_not(spark, forest):
    at = secrets.FEATURES.index("testpath")

    def splits(t):
        return isinstance(t, tuple) and (t[0] == at or splits(t[2]) or splits(t[3]))

    assert sum(map(splits, forest.trees)) >= len(forest.trees) // 2
    value = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    paths = ["src/app.py", "config/site.yml", None, "tests/fixtures/a.json", "docs/readme.md"]
    df = spark.createDataFrame([(i, f'erist token = "{value}" and', p) for i, p in enumerate(paths)], "doc_id long, text string, path string")
    got = [r.is_secret for r in secrets.scan(df, forest, path="path").orderBy("doc_id").collect()]
    assert got == [True, True, True, False, False]


def test_bare_and_quoted_values_by_name_and_sign(spark, forest):
    texts = {
        "password = hunter2secretpw": "hunter2secretpw",
        "api_key: qwlkejrhtbvmznxplqkdjfhg, then": "qwlkejrhtbvmznxplqkdjfhg",
        "DB_PASSWORD=s3cr3tV4lue99;": "s3cr3tV4lue99",
        '"access-key" => "Zq81xx!é-über"': "Zq81xx!é-über",
        "secret := abcdefgh1=": "abcdefgh1=",
        "the password: sometimes they wait": None,
        "token=short1": None,
        "password = f(abcdefgh12)": None,
        "my token, abcdefgh1": None,
        "password:\nabcdefgh1": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.value) for r in secrets.scan(df, forest).collect()}
    assert got == {i: (t.index(v), v) for i, (t, v) in enumerate(texts.items()) if v}
    # a value's own start: no candidate begins inside another, long ones are whole
    long = "password=" + "a1" * 50_000 + " end"
    one = secrets.scan(spark.createDataFrame([(1, long)], "doc_id long, text string"), forest).collect()
    assert [(r.start, len(r.value)) for r in one] == [(9, 100_000)]
    assert secrets.labelled_findings(spark, 200).filter(~F.col("text").rlike(secrets.CANDIDATE)).count() == 0
