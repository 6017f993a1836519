import pytest
from pyspark.sql import functions as F

from tidewell.functions import redaction as R
from tidewell.functions import scores as C
from tidewell.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_markers_withhold_the_whole_value(spark):
    got = one(spark, R.scrub, "key is ghp_abc and AKIA123")
    assert got.status == "quarantined" and got.rules == ["aws_access_key_id", "github_pat"]
    assert "ghp_" not in got.text and "26 bytes" in got.text


def test_spans_are_replaced_and_the_rest_stays(spark):
    cases = {
        "db postgres://admin:hunter2@host/prod": ("db postgres://admin:[redacted]@host/prod", ["uri_credentials"]),
        "see http://host:80/a@b": ("see http://host:80/a@b", []),
        "card 4111 1111 1111 1111 ok": ("card [redacted-card] ok", ["card_number"]),
        "order 4111 1111 1111 1112 ok": ("order 4111 1111 1111 1112 ok", []),
        "ssn 123-45-6789.": ("ssn [redacted-ssn].", ["ssn"]),
        "not 000-45-6789 666-45-6789 923-45-6789 1123-45-6789": ("not 000-45-6789 666-45-6789 923-45-6789 1123-45-6789", []),
        "a Bearer token": ("a Bearer token", []),
        "Bearer abcdefghijklmnop1": ("Bearer [redacted]", ["bearer_token"]),
    }
    for text, (kept, rules) in cases.items():
        got = one(spark, R.scrub, text)
        assert (got.text, got.rules) == (kept, rules), text
        assert got.status == ("redacted" if rules else "clean")
    assert one(spark, R.scrub, None).text is None


def test_random_runs_count_in_tool_output_only(spark):
    run = "aB3dE5gH7jK9mN1pQ2rS4tU6vW8xY0zA+c/e"
    assert one(spark, R.scrub, f"x {run} y").status == "clean"
    assert one(spark, lambda t: R.scrub(t, True), f"x {run} y").text == "x [redacted-secret] y"
    assert one(spark, lambda t: R.scrub(t, True), "a" * 40).status == "clean"


def test_denied_paths_withhold_results(spark):
    got = spark.sql("select 'secret' r, '/home/x/.aws/credentials' p").select(R.tool_result(F.col("r"), F.col("p")).alias("x")).first().x
    assert got.status == "quarantined" and "secret" not in got.text
    for path, denied in (("/a/.env", True), ("/a/main.py", False), ("/k/server.pem", True)):
        assert one(spark, T.is_denied_path, path) is denied


def test_negation_is_a_word_not_a_substring(spark):
    for text, negated in (("it is not so", True), ("it isn't.", True), ("a known container", False), ("(never)", True), ("", False)):
        assert one(spark, T.has_negation, text) is negated, text


def test_cleaning(spark):
    assert one(spark, lambda t: T.visible(t, 10), " a​b\x07c\n ") == "abc"
    assert one(spark, lambda t: T.visible(t, 3), "abcdef") == "abc…[truncated]"
    assert one(spark, lambda t: T.visible_line(t, 99), "a\n\n b\tc") == "a b c"
    assert one(spark, T.without_injected, "x <injected id=1>secret</injected> y <injected>tail") == "x  y "
    assert one(spark, T.json_payload, "```json\n{\"a\":1}\n```") == '{"a":1}'
    assert one(spark, T.json_payload, 'sure: {"a":1} bye') == '{"a":1}'
    assert one(spark, T.json_payload, "no") == "no"
    assert one(spark, T.short_path, "/a/b/c.py") == "b/c.py"
    assert one(spark, lambda t: T.command_text(t, F.lit("Bash")), '{"command": "ls"}') == "ls"
    assert one(spark, lambda t: T.command_text(t, F.lit("Bash")), '{"command": 3}') == '{"command": 3}'
    assert one(spark, lambda t: T.command_text(t, F.lit("Bash")), None) == "Bash"


def test_trust_and_confidence(spark):
    r = spark.sql("select 0L n, 0.5D b union all select 3L, 0D union all select 300L, 0D union all select 300L, 1D").select(F.round(C.trust_multiplier(F.col("n"), F.col("b")), 4).alias("t")).collect()
    assert [x.t for x in r] == [1.0, 1.06, 1.2885, 0.7115]
    assert one(spark, lambda t: C.confidence(t.cast("long"), F.lit(None).cast("double")), "2") == 0.8


def test_epochs_that_no_clock_shows(spark):
    r = spark.sql("select 1700000000.1239D s union all select double('nan') union all select 1e13D union all select null").select(C.instant_of_epoch(F.col("s")).alias("t")).collect()
    assert [x.t for x in r] == ["2023-11-14T22:13:20.123Z", None, None, None]


def test_since():
    from datetime import UTC, datetime, timedelta

    now = datetime(2024, 3, 1, tzinfo=UTC)
    assert T.since("90d", now) == now - timedelta(days=90) and T.since(" 45m ", now) == now - timedelta(minutes=45)
    assert T.since("2024-02-29", now) == datetime(2024, 2, 29, tzinfo=UTC)
    assert T.since("2024-02-29T01:00:00+01:00", now) == datetime(2024, 2, 29, tzinfo=UTC)
    for bad in ("", "d", "5w", "2024-13-01", "99999999999d", "yesterday"):
        with pytest.raises(ValueError):
            T.since(bad, now)


def test_capped_text_has_whole_characters(spark):
    for n in range(8):
        raw = "a" * n + "é🙂ß🙂"
        for most in range(1, 12):
            cut = raw.encode()[:most].decode("utf-8", "ignore")
            want = raw if len(raw.encode()) <= most else cut + "..."
            assert one(spark, lambda t, most=most: T.capped(t, most, "..."), raw) == want
