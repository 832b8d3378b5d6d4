"""Trust of a source, derived from its URL or path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.text import strip
from recollect.settings import DEFAULTS, TRUSTED_LABELS, TRUSTED_ZONES, Trust


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_host(source: Column) -> Column:
    """Lower-case host of a URL-like text, '' when there is none."""
    s = strip(source)
    full = F.when(F.instr(s, "://") > 0, s).otherwise(F.concat(F.lit("http://"), s))
    netloc = F.element_at(F.split(url_netloc(full), "@"), -1)
    return F.lower(F.btrim(F.substring_index(netloc, ":", 1), F.lit(".")))


def _any(words) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def trusted_domain(host: Column, trust: Trust = DEFAULTS.trust) -> Column:
    """Authoritative zone, documentation label, or a listed domain or its child."""
    names = [n for n in (d.strip().lower().lstrip(".") for d in trust.domains) if n]
    rules = [rf"^{_any(TRUSTED_LABELS)}(?:\.|\z)", rf"\.{_any(TRUSTED_ZONES)}\z"]
    if names:
        rules.append(rf"(?:^|\.){_any(names)}\z")
    return F.ltrim(F.lower(host), F.lit(".")).rlike("|".join(rules))


def source_trust(source: Column, trust: Trust = DEFAULTS.trust) -> Column:
    s = strip(F.coalesce(source, F.lit("")))
    local = "|".join([
        re.escape(trust.local_marker), _any(trust.local_suffixes) + r"\z", "^" + _any(trust.local_prefixes),
    ])
    host = url_host(s)
    of_url = (
        F.when(host == "", F.lit(trust.default))
        .when(trusted_domain(host, trust), F.lit(trust.trusted))
        .otherwise(F.lit(trust.unknown_url))
    )
    return (
        F.when(s == "", F.lit(trust.default))
        .when(s.rlike(r"://|^(?i:www\.)"), of_url)
        .when(F.lower(s).rlike(local), F.lit(trust.local_doc))
        .otherwise(F.lit(trust.default))
    )


def clamp_trust(value: Column, trust: Trust = DEFAULTS.trust) -> Column:
    """Into [0, 1]; what is no number becomes the default."""
    number = F.coalesce(value.try_cast("double"), F.lit(trust.default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
