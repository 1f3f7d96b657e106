"""E-mail addresses, phone numbers and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tributary.functions.arrays import or_empty
from tributary.functions.dims import PLATFORM_PATTERNS, PLATFORMS
from tributary.functions.text import null_if_empty

# Patterns by which addresses, numbers and profiles are found in prose.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:(?:\+?1\s?)?(?:\(?\d{3}\)?)[\s.\-]?\d{3}[\s.\-]?\d{4}|\+\d{1,3}[\s.\-]?\d{2,4}[\s.\-]?\d{2,4}[\s.\-]?\d{2,9})"
LINKEDIN, GITHUB = r"(?i)linkedin\.com/in/[\w\-]+", r"(?i)github\.com/[\w\-]+"
E164 = r"^\+[1-9]\d{6,14}$"

#: Syntax of a valid address: dot-separated atoms, and a host of labels with a top level of letters.
VALID_EMAIL = r"^[a-z0-9!#$%&'*+/=?^_`{|}~\-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~\-]+)*@([a-z0-9]([a-z0-9\-]*[a-z0-9])?\.)+[a-z]{2,}$"
DOTLESS = ("gmail.com", "googlemail.com")


def found(text: Column, pattern: str) -> Column:
    """Distinct matches in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def is_email(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.coalesce(low.rlike(VALID_EMAIL) & (F.length(low) <= 254) & (F.instr(low, "@") <= 65), F.lit(False))


def normal_email(c: Column) -> Column:
    """Lower case, without what follows a plus, for dotless hosts without dots; null if invalid."""
    low = F.lower(F.trim(c))
    local, host = F.split_part(F.split_part(low, F.lit("@"), F.lit(1)), F.lit("+"), F.lit(1)), F.split_part(low, F.lit("@"), F.lit(2))
    return F.when(is_email(c), F.concat(F.when(host.isin(*DOTLESS), F.replace(local, F.lit("."), F.lit(""))).otherwise(local), F.lit("@"), host))


def normal_emails(a: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(or_empty(a), normal_email)))


#: Ten digits of the North American plan.
NANP = r"^[2-9]\d{2}[2-9]\d{6}$"


def normal_phone(c: Column) -> Column:
    """E.164 by the North American plan or, after a plus, by length; null if it can't be a number. Numbers without a country code are taken as US ones."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"(?i)^(?:(?:tel:|phone:|ph:|ph\.:|fax:)\s*)+", ""))
    digits = F.regexp_replace(bare, r"\D", "")
    abroad = F.startswith(bare, F.lit("+"))
    home = F.when(F.startswith(digits, F.lit("1")) & (F.length(digits) == 11), F.substring(digits, 2, 10)).when(~abroad, digits)
    return F.when(
        bare.rlike(r"^\+?[\d\s().\-/]+$"),
        F.when(home.rlike(NANP), F.concat(F.lit("+1"), home)).when(abroad & ~F.startswith(digits, F.lit("1")) & digits.rlike(r"^[2-9]\d{6,14}$"), F.concat(F.lit("+"), digits)),
    )


def normal_phones(a: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(or_empty(a), normal_phone)))


def is_phone(c: Column) -> Column:
    return normal_phone(c).isNotNull()


def phone_region(c: Column) -> Column:
    """US for North American numbers; other regions need a table of country codes, which a caller may join on the number's prefix."""
    return F.when(F.startswith(normal_phone(c), F.lit("+1")), "US")


def normal_url(c: Column, strip_www: bool = False) -> Column:
    """With a scheme, a host in lower case, no default port, no trailing slash, query or fragment; null without a host."""
    given = F.trim(c)
    url = F.when(given.rlike(r"^(http|https|ftp)://"), given).otherwise(F.concat(F.lit("https://"), given))
    scheme = F.regexp_extract(url, r"^([a-z]+)://", 1)
    place = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1), r"^.*@", "")
    host, port = F.lower(F.regexp_extract(place, r"^([^:]*)", 1)), F.regexp_extract(place, r":(\d+)$", 1)
    if strip_www:
        host = F.regexp_replace(host, r"^www\.", "")
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    path = F.rtrim(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/"))
    shown = F.when((port == "") | default, host).otherwise(F.concat(host, F.lit(":"), port))
    return F.when((given != "") & (place != ""), F.concat(scheme, F.lit("://"), shown, F.when(path == "", F.lit("/")).otherwise(path)))


def normal_urls(a: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(or_empty(a), lambda x: normal_url(x))))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def platform(url: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(PLATFORM_PATTERNS):
        out = F.when(url.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def known_platform(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*PLATFORMS), low).otherwise("other")


def first_path_part(url: Column) -> Column:
    return null_if_empty(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*/+([^/?#]+)", 1))


def code_host_user(source: Column) -> Column:
    """User of a code-host URL, or the string itself if it is a plain name."""
    host = F.lower(F.regexp_extract(source, r"^(?:[A-Za-z]+://)?+([^/?#]*)", 1))
    part = null_if_empty(F.regexp_extract(source, r"^(?:[A-Za-z]+://)?+[^/?#]*/+([^/?#]+)", 1))
    return F.when(F.contains(host, F.lit("github.com")), part).when(~F.contains(source, F.lit("/")) & (source != ""), source)
