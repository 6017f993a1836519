"""Column expressions over captured text: hashes, predicates, cleaning, short forms."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fragments of commands that run tests, of paths whose content is withheld,
# and words that negate.
TEST_FRAGMENTS = ("cargo test", "pytest", "py.test", "npm test", "npm run test", "yarn test", "go test", "jest", "mvn test", "make test", "gradle test", "rspec", "phpunit")
DENIED_FRAGMENTS = (
    "/.aws/credentials", "/.aws/config", "/.ssh/id_", "/.netrc", "/.npmrc", "/.pypirc", "/.docker/config.json", "/.kube/config",
    "/secrets/", "/vault/", ".env", "/.git-credentials", "/.config/gh/hosts.yml", "/.config/gcloud/", "/.azure/", "/.gnupg/",
    "/terraform.tfstate", ".pem", ".key", ".p12", ".pfx", ".jks", "/id_rsa", "/id_ed25519", "/id_ecdsa",
)
NEGATIONS = ("not", "no", "never", "none", "nobody", "nothing", "nowhere", "neither", "cannot")
#: Characters that display as nothing or turn the direction of text.
INVISIBLE = "\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff"
#: Bytes a substantive line has at least.
SUBSTANTIVE = 12


def any_of(fragments: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, fragments))


def content_hash(text: Column) -> Column:
    """``sha256:`` and the hex digest of the UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def is_test_command(command: Column) -> Column:
    return F.lower(command).rlike(any_of(TEST_FRAGMENTS))


def is_denied_path(path: Column) -> Column:
    return path.rlike(any_of(DENIED_FRAGMENTS))


def is_commit(command: Column) -> Column:
    return F.lower(command).rlike(r"^(?U)\s*git commit")


def words(text: Column) -> Column:
    """Distinct lower-cased words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def has_negation(text: Column) -> Column:
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}']+|[^\p{L}\p{N}']+$", "")
    return F.exists(words(text), lambda w: bare(w).isin(*NEGATIONS) | bare(w).endswith("n't"))


def normalized_claim(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def command_text(tool_input: Column, name: Column) -> Column:
    """The string field ``command`` of a JSON input, else the input, else the tool's name."""
    parsed = F.try_parse_json(tool_input)
    is_text = F.schema_of_variant(F.try_variant_get(parsed, "$.command", "variant")) == "STRING"
    return F.coalesce(F.when(is_text, F.try_variant_get(parsed, "$.command", "string")), tool_input, name)


def visible(text: Column, most: int, marker: str = "…[truncated]") -> Column:
    """Without control and invisible characters, trimmed, cut to ``most`` characters with a marker."""
    kept = F.regexp_replace(F.regexp_replace(text, rf"[\p{{Cc}}&&[^\n\t]]|[{INVISIBLE}]", ""), r"(?U)^\s+|\s+$", "")
    return F.when(F.char_length(kept) > most, F.concat(F.substring(kept, 1, most), F.lit(marker))).otherwise(kept)


def terminal_text(text: Column, most: int = 200, marker: str = "…[truncated]") -> Column:
    """For a terminal: without any control or invisible character, line ends included, cut to ``most`` characters; not trimmed."""
    kept = F.regexp_replace(text, r"[\p{Cc}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]", "")
    return F.when(F.char_length(kept) > most, F.concat(F.substring(kept, 1, most), F.lit(marker))).otherwise(kept)


def capped(text: Column, most: int = 1 << 20, marker: str = "...[truncated]") -> Column:
    """At most ``most`` UTF-8 bytes, no character cut in two, and a marker where something went."""
    raw = text.cast("binary")
    # the last byte kept is followed by the begin of a character; a character has 4 bytes at most
    begins = F.filter(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.conv(F.hex(F.substring(raw, F.lit(most + 1) - k, F.lit(1))), 16, 10).cast("int").bitwiseAND(0xC0) != 0x80)
    cut = F.decode(F.substring(raw, F.lit(1), F.lit(most) - F.get(begins, F.lit(0))), "UTF-8")
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit(marker))).otherwise(text)


def segment_problem(value: Column) -> Column:
    """Why a value can't be one part of a path, or null."""
    return F.when(F.coalesce(value, F.lit("")) == "", "empty").when(value.isin(".", ".."), "dots").when(value.rlike(r"[/\\\x00]"), "not one segment")


def visible_line(text: Column, most: int, marker: str = "…[truncated]") -> Column:
    """visible() in one line, each run of white space a space."""
    return F.regexp_replace(F.regexp_replace(visible(text, most, marker), r"(?U)\s+", " "), "^ | $", "")


def flat_line(text: Column, most: int) -> Column:
    """In one line, cut to ``most`` characters with an ellipsis."""
    line = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.char_length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def without_injected(text: Column, tag: str = "injected") -> Column:
    """Without <tag ...>...</tag> blocks; what follows an unclosed one goes too."""
    return F.regexp_replace(text, rf"(?s)<{tag}(?:[^>]*>.*?(?:</{tag}>|\z)|[^>]*\z)", "")


def short_path(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def json_payload(text: Column) -> Column:
    """What a fenced block holds, else from the first ``{`` to the last ``}``, else the text."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    fenced = F.regexp_extract(t, r"(?s)\A```(?:json)?[\r\n]*(.*)```\z", 1)
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    trimmed = F.regexp_replace(fenced, r"(?U)^\s+|\s+$", "")
    return F.when(t.rlike(r"(?s)\A```(?:json)?[\r\n]*.*```\z"), trimmed).when(braces != "", braces).otherwise(t)


def short_command(command: Column) -> Column:
    """First line, trimmed, cut to 60 characters."""
    line = F.trim(F.element_at(F.split(command, r"\r?\n"), 1))
    return F.when(F.char_length(line) <= 60, line).otherwise(F.concat(F.substring(line, 1, 57), F.lit("...")))


def longest_substantive(transcript: Column) -> Column:
    """Bytes of real content in the longest line: no header, no [id], no bare tool name."""
    lines = F.filter(F.split(transcript, "\n"), lambda x: ~F.ltrim(x).startswith("session_id:"))
    rest = lambda x: F.regexp_replace(x, r"^.*?\] ", "")
    size = lambda x: F.when(rest(x).startswith("tool:"), F.octet_length(F.trim(F.regexp_extract(rest(x), r"^tool:\S* (.*)$", 1)))).otherwise(F.octet_length(F.trim(rest(x))))
    return F.coalesce(F.array_max(F.transform(lines, size)), F.lit(0))


def since(spec: str, now: datetime) -> datetime:
    """The instant that ``90d``, ``36h``, ``45m`` or ``30s`` before ``now``, a date (midnight UTC) or an RFC 3339 time names."""
    spec = spec.strip()
    if found := re.fullmatch(r"([0-9]+)([dhms])", spec):
        unit = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}[found[2]]
        try:
            return now - timedelta(**{unit: int(found[1])})
        except OverflowError:
            raise ValueError(f"{spec}: reaches before the year 1") from None
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", spec):
        spec += "T00:00:00Z"
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})", spec):
        raise ValueError(f"{spec!r} is no window (90d, 36h, 45m, 30s), date or RFC 3339 time")
    return datetime.fromisoformat(spec)


def edited_paths(result: Column) -> Column:
    """Sorted distinct paths that a tool's JSON result says it edited: its own, and those of its patches."""
    v = F.try_parse_json(result)
    text = lambda x, path: F.when(F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string"))
    entries = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))
    patched = F.transform(F.concat(entries("structuredPatch"), entries("bashEditDiff")), lambda e: F.array(*[text(e, f"$.{k}") for k in ("filePath", "file", "path")]))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(text(v, "$.filePath")), F.flatten(patched)))))
