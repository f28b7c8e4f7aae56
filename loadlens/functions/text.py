"""Text and value functions: tokens, similarity, canonical forms, flags, identifiers, safety predicates."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: White space that separates tokens: the Unicode class and the four information separators.
GAP = r"(?U)[\s\x1c-\x1f]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased words between white space, repeats included."""
    return F.array_remove(F.split(F.lower(_col(text)), GAP), "")


def jaccard(a: Column, b: Column) -> Column:
    """Share of distinct common elements of two arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _json_writer(compact: bool, ascii_only: bool, sort: bool, without: tuple[str, ...]):
    separators = (",", ":") if compact else (", ", ": ")

    def constant(name: str):
        raise ValueError(name)

    def write(value: str | None) -> str | None:
        try:
            parsed = json.loads(value, parse_constant=constant)
            if without:
                parsed = {k: v for k, v in parsed.items() if k not in without}
            return json.dumps(parsed, sort_keys=sort, separators=separators, ensure_ascii=ascii_only, allow_nan=False)
        except (TypeError, ValueError, AttributeError, RecursionError):
            return None

    return write


def canonical_json(value: Column | str, compact: bool = True, ascii_only: bool = True, sort: bool = True, without: tuple[str, ...] = ()) -> Column:
    """Canonical text of a JSON text: keys sorted at every level, types kept, numbers in shortest form; null if it is not JSON or not finite.

    Bytes must agree with other writers of this form, whose number and escape forms no built-in function has; so an
    Arrow-batched function parses and writes. ``without`` names keys of an object that are left out.
    """
    write = _json_writer(compact, ascii_only, sort, without)

    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(write).astype(object)

    return run(_col(value))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def condition_id(kind: Column | str, value: Column | str) -> Column:
    """``kind:value``; a whole value has no decimal point, others their shortest digits, with an exponent only below 0.0001 and from 1e16."""
    v = _col(value).cast("double")
    t = v.cast("string")
    parts = r"^(\d)\.(\d+)E(-?\d+)$"
    digits = F.regexp_replace(F.concat(F.regexp_extract(t, parts, 1), F.regexp_extract(t, parts, 2)), "0+$", "")
    power = F.regexp_extract(t, parts, 3).try_cast("int")
    mantissa = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 99))).otherwise(digits)
    shown = (
        F.when(power.isNull(), t)
        .when(power < -4, F.concat(mantissa, F.lit("e-"), F.lpad((-power).cast("string"), F.greatest(F.lit(2), F.length((-power).cast("string"))), F.lit("0"))))
        .when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(99))))
    )
    return F.concat(_col(kind), F.lit(":"), F.when(v == F.rint(v), v.cast("decimal(38,0)").cast("string")).otherwise(shown))


def offset_timestamp(text: Column | str) -> Column:
    """Timestamp of an ISO text that names its offset; null otherwise."""
    t = _col(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(t))


def flag_name(name: Column | str) -> Column:
    return F.lower(F.replace(_col(name), F.lit("_"), F.lit("-")))


def has_alias_collision(names: Column) -> Column:
    """Whether two of the names are one after normalisation."""
    return F.size(F.array_distinct(F.transform(names, flag_name))) < F.size(names)


def canonical_positive_int(text: Column | str, most: int = 2_147_483_647) -> Column:
    """The number that a canonical positive decimal spells, up to ``most``; null otherwise."""
    t = _col(text)
    n = F.when(t.rlike("^[1-9][0-9]{0,9}$"), t.try_cast("long"))
    return F.when(n <= most, n)


def last_user_text(turns: Column) -> Column:
    """Content of the last message of role user in an ordered array of (role, content)."""
    return F.try_element_at(F.filter(turns, lambda m: m["role"] == "user"), F.lit(-1))["content"]


def prompt_text(turns: Column) -> Column:
    """``role: content`` lines of an ordered array of messages; a message without a role is the user's, one without content is left out."""
    said = F.filter(turns, lambda m: m["content"].isNotNull())
    return F.array_join(F.transform(said, lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), m["content"])), "\n")


def pieces(text: Column | str, size: int = 10) -> Column:
    """The text in pieces of ``size`` characters; none of an empty text."""
    t = _col(text)
    n = F.ceil(F.length(t) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(t, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def scope_key(request: Column | str) -> Column:
    """JSON of a request without its messages and stream flag, keys sorted at every level and types kept: 0 and "0" are different scopes."""
    return canonical_json(request, compact=False, without=("messages", "stream"))


def count_map_strict(statuses: Column, errors: Column, finishes: Column, n: Column) -> Column:
    """Whether count maps say that all ``n`` responses are status 200, without errors, of accepted finish reasons."""
    ok = ("stop", "length", "content_filter")
    total = F.aggregate(F.map_values(finishes), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.coalesce((F.size(statuses) == 1) & (F.try_element_at(statuses, F.lit("200")) == n) & (F.size(errors) == 0) & F.forall(F.map_keys(finishes), lambda k: k.isin(*ok)) & (total == n), F.lit(False))


def immutable_digest(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike("^(sha256:[0-9a-f]{64}|.+@sha256:[0-9a-f]{64})$"), F.lit(False))


def immutable_revision(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike("^([0-9a-f]{40}|[0-9a-f]{64})$"), F.lit(False))


# Shapes that public metadata must not hold: assigned credentials, tokens by their prefixes, signed tokens, addresses, absolute paths and traversal.
_LABEL = r"access[\s_-]*token|api[\s_-]*key|auth[\s_-]*token|authorization|bearer|client[\s_-]*secret|credentials?|password|passwd|private[\s_-]*key|secret(?:[\s_-]*key)?|token"
_DIGEST = r"[A-Za-z][A-Za-z0-9._+-]{0,31}:[0-9A-Fa-f]{16,256}"
_NAME = r"[A-Za-z0-9][A-Za-z0-9._/+:-]{0,183}"
_OPENS = r"(?:^|[\s=\"'(<\[{,;:])"
UNSAFE = (
    rf"(?iU)(?:^|[^a-z0-9])(?:{_LABEL})\s*[:=]",
    r"(?i)(?:^|[^A-Za-z0-9])(?:(?:hf|npm|pk|pypi|rk|rpa|rps|sk)[-_][A-Za-z0-9_-]{8,}|gh[oprsu]_[A-Za-z0-9_]{8,}|github_pat_[A-Za-z0-9_]{8,}|glpat-[A-Za-z0-9_-]{8,}|xox[baprs]-[A-Za-z0-9-]{8,}|(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{20,}|SG\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|ya29\.[A-Za-z0-9_-]{8,})(?=$|@|[^A-Za-z0-9_])",
    r"(?:^|[^A-Za-z0-9_])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"(?i)://|bearer |authorization:",
    rf"(?iU)file:(?:/{{1,2}}|\\)|data:[^\s,;]{{1,128}}[,;]|mailto:[^\s@]+@|{_OPENS}(?:data|file|ftp|ftps|gs|https?|mailto|s3|ssh):",
    rf"(?U){_OPENS}(?:/(?!/)(?=[A-Za-z0-9._~-])|~[/\\]|[A-Za-z]:[/\\]|[/\\]{{2}}[^/\\\s])",
    r"(?U)(?:^|[\s=\"'(<\[{,;:/\\])\.\.?(?=$|[/\\])",
    r"^(?:/|~/|\\|[A-Za-z]:[\\/])|(?:^|[/\\])\.\.?(?:$|[/\\])",
)
#: Controls, format characters, surrogates, line and paragraph separators.
_BARRED = r"[\p{Cc}\p{Cf}\p{Cs}\p{Zl}\p{Zp}]"
_USER = r"[^\s:@/\\]+:"


def _unsafe_form(t: Column) -> Column:
    """Whether a text has an unsafe shape or a user and a secret before an at sign; the digest of an artifact's name may stand behind one."""
    artifact = t.rlike(rf"^(?:{_DIGEST}|{_NAME}(?:@{_DIGEST})?)$")
    bad = t.rlike(rf"(?iU){_USER}(?:{_LABEL})@") | (~artifact & t.rlike(rf"(?U){_USER}[^\s:@/\\]+@")) | t.rlike(rf"(?U){_USER}[^\s:@/\\]+@(?!{_DIGEST}(?=$|\s))")
    for shape in UNSAFE:
        bad = bad | t.rlike(shape)
    return bad


def safe_metadata(text: Column | str, most: int = 256) -> Column:
    """Whether a text as it stands may be published: not empty, no white space at its ends, at most ``most`` bytes, no barred character and no unsafe shape. False for null."""
    t = _col(text)
    return F.coalesce((t != "") & (F.octet_length(t) <= most) & ~t.rlike(r"(?U)^\s|\s$") & ~t.rlike(_BARRED) & ~_unsafe_form(t), F.lit(False))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form of texts, which no built-in function gives."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t)).astype(object)


def public_metadata(text: Column | str, most: int = 256) -> Column:
    """Whether a text may be published both as it stands and in its compatibility form, which may be four times as long, and is no odd spelling of ``unknown``.

    Only texts beyond ASCII are handed to the function that normalises.
    """
    t = _col(text)
    ascii_only = t.rlike(r"^[\x00-\x7F]*$")
    form = F.coalesce(nfkc(F.when(~ascii_only, t)), t)
    sized = (form != "") & (F.length(form) <= 4 * F.length(t)) & (F.octet_length(form) <= most) & ~form.rlike(r"(?U)^\s|\s$") & ~((F.lower(form) == "unknown") & (t != "unknown"))
    return F.coalesce(safe_metadata(t, most) & sized & ~_unsafe_form(form), F.lit(False))


def loopback(host: Column | str) -> Column:
    return F.coalesce(_col(host).rlike(r"^(localhost|127(\.\d{1,3}){3}|\[?::1\]?)$"), F.lit(False))


def chat_url(url: Column | str) -> Column:
    """Address of the chat route that a base address stands for; null unless it is https, or http on the machine itself."""
    u = F.regexp_replace(_col(url), "/+$", "")
    host = F.try_parse_url(u, F.lit("HOST"))
    secure = (F.try_parse_url(u, F.lit("PROTOCOL")) == "https") | ((F.try_parse_url(u, F.lit("PROTOCOL")) == "http") & loopback(host))
    route = F.when(u.endswith("/chat/completions"), u).when(u.endswith("/v1"), F.concat(u, F.lit("/chat/completions"))).otherwise(F.concat(u, F.lit("/v1/chat/completions")))
    return F.when(secure & F.try_parse_url(u, F.lit("QUERY")).isNull() & F.try_parse_url(u, F.lit("USERINFO")).isNull(), route)
