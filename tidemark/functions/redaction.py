"""Masking of credentials in text, as chains of built-in regular-expression functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "<REDACTED>"

# fixed values: names that mark a credential
CREDENTIAL_WORDS = "key|token|secret|auth|password|passwd|pwd|credential|cookie|session|sso"

# a quoted Authorization value: plain runs and escaped characters in turn. Every repeat is possessive, so the
# engine neither recurses nor goes back, however long the value is
_QUOTE, _RUN = r"""["']""", r"""[^"'\\]*+"""
AUTH_JSON = rf"""({_QUOTE}authorization{_QUOTE}\s*+:\s*+{_QUOTE})(?!{_QUOTE}){_RUN}(?:\\["'\\]{_RUN})*+({_QUOTE})"""
# a header line: the scheme word stays, the rest of the line goes
AUTH_HTTP = r"(authorization\s*+:\s*+[A-Za-z0-9_+-]++\s++)[^\r\n]++"
# what stands before the word is kept anyway, so a match starts at the word itself: the scan is
# linear, and the possessive repeats never try a run twice
CREDENTIAL = (
    r"""((?:""" + CREDENTIAL_WORDS + r""")[A-Za-z0-9_-]*+"?\s*+[=:]\s*+"?)([^"'&\s,;}\]<]+)"""
)
_SEGMENT = r"[A-Za-z0-9_-]{8,}+"
JWT = rf"\beyJ{_SEGMENT}(?:\.{_SEGMENT}){{2}}"

# fixed values: shortest value worth masking when writing and when showing
MIN_LENGTH_WRITE = 12
MIN_LENGTH_SHOW = 16


def redact_credentials(text: Column) -> Column:
    """Header forms run before the general one, which would stop at the scheme word.

    The header and token patterns only run on texts that hold their fixed word.
    """
    named = F.contains(F.lower(text), F.lit("authorization"))
    quoted = F.regexp_replace(text, "(?iU)" + AUTH_JSON, f"$1{MASK}$2")
    headers = F.regexp_replace(quoted, "(?iU)" + AUTH_HTTP, f"$1{MASK}")
    out = F.regexp_replace(F.when(named, headers).otherwise(text), "(?iU)" + CREDENTIAL, f"$1{MASK}")
    return F.when(F.contains(out, F.lit("eyJ")), F.regexp_replace(out, JWT, MASK)).otherwise(out)


def secret_forms(values: Sequence[str], min_length: int = MIN_LENGTH_WRITE) -> list[str]:
    """Each value with its percent-encoded and decoded form, longest first."""
    forms: set[str] = set()
    for value in values:
        if value and len(value) >= min_length:
            forms |= {f for f in (value, quote(value, safe=""), unquote(value)) if len(f) >= min_length}
    return sorted(forms, key=lambda f: (-len(f), f))


def mask_known_values(text: Column, values: Sequence[str], min_length: int = MIN_LENGTH_WRITE) -> Column:
    return reduce(
        lambda out, form: F.replace(out, F.lit(form), F.lit(MASK)), secret_forms(values, min_length), text
    )


def redact_url_param(url: Column, name: str) -> Column:
    """Mask the first value of one query parameter up to the next ``&`` or the end."""
    escaped = "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in name)
    return F.regexp_replace(url, rf"(?s)^(.*?{escaped}=)[^&]*", f"$1{MASK}")


def scrub_params(params: Column) -> Column:
    """Mask the map values whose key looks like a credential."""
    return F.transform_values(
        params, lambda k, v: F.when(k.rlike(f"(?i)({CREDENTIAL_WORDS})"), F.lit(MASK)).otherwise(v)
    )
