import pytest
from pyspark.sql import functions as F

from tidemark.functions import redaction as red

CASES = [
    ('{"serviceKey":"abc123def"}', '{"serviceKey":"<REDACTED>"}'),
    ("url?api_key=abc&x=1", "url?api_key=<REDACTED>&x=1"),
    ("client_secret: s3cr3t, next", "client_secret: <REDACTED>, next"),
    ("JSESSIONID=AB12; path=/", "JSESSIONID=<REDACTED>; path=/"),
    ("<serviceKey>abc</serviceKey>", "<serviceKey>abc</serviceKey>"),
    ("Authorization: Bearer abc.def\r\nHost: x", "Authorization: <REDACTED> <REDACTED>\r\nHost: x"),
    ('{"Authorization":"Digest a=\\"b\\", c=d","x":1}', '{"Authorization":"<REDACTED>","x":1}'),
    ("err eyJabcdefgh1.abcdefgh2.abcdefgh3 end", "err <REDACTED> end"),
    ("a=token=abc", "a=token=<REDACTED>"),
    ("nothing to see, keys are fine", "nothing to see, keys are fine"),
    ("KEY = 'v'", "KEY = 'v'"),
    # values far beyond what a recursive match could take
    ('{"Authorization": "' + "x" * 100_000 + '"}', '{"Authorization": "<REDACTED>"}'),
    ('{"Authorization": "' + "x\\\"" * 20_000 + '"}', '{"Authorization": "<REDACTED>"}'),
    ("Authorization: Basic " + "y" * 100_000, "Authorization: <REDACTED> <REDACTED>"),
]


@pytest.fixture(scope="module")
def redacted(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    once = df.select("i", red.redact_credentials(F.col("t")).alias("t"))
    twice = once.select("i", red.redact_credentials(F.col("t")).alias("t"))
    return dict(tuple(r) for r in once.collect()), dict(tuple(r) for r in twice.collect())


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases_and_idempotence(redacted, i):
    once, twice = redacted
    assert once[i] == CASES[i][1]
    assert twice[i] == once[i]


def test_the_twin_spells_out_the_same_rule():
    import duckdb

    from tidemark.queries.scalars import _redacted

    more = [
        ("key: token: abc", "key: <REDACTED> abc"), ("token==abc x", "token=<REDACTED> x"), ('token="" y', 'token="" y'),
        ("token=", "token="), ("my_key=a=b,c auth: d", "my_key=<REDACTED>,c auth: <REDACTED>"),
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, c[0]) for i, c in enumerate(CASES + more)])
    got = con.sql(f"WITH {_redacted('t', 'i')} SELECT text FROM CLEAN ORDER BY i").fetchall()
    assert [r[0] for r in got] == [c[1] for c in CASES + more]


def test_known_values_longest_form_first(spark):
    secret = "abc/def+ghi=12345"
    text = "raw abc/def+ghi=12345 enc abc%2Fdef%2Bghi%3D12345 short tiny"
    got = spark.range(1).select(red.mask_known_values(F.lit(text), [secret, "tiny"])).collect()[0][0]
    assert got == "raw <REDACTED> enc <REDACTED> short tiny"
    assert red.secret_forms(["short"]) == []
    assert red.secret_forms([secret], red.MIN_LENGTH_SHOW)[0] == "abc%2Fdef%2Bghi%3D12345"


@pytest.mark.parametrize(
    "url, expected",
    [
        ("http://x?serviceKey=ab%2F&n=1", "http://x?serviceKey=<REDACTED>&n=1"),
        ("http://x?n=1&serviceKey=ab", "http://x?n=1&serviceKey=<REDACTED>"),
        ("http://x?n=1", "http://x?n=1"),
    ],
)
def test_url_param(spark, url, expected):
    assert spark.range(1).select(red.redact_url_param(F.lit(url), "serviceKey")).collect()[0][0] == expected
