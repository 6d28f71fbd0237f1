"""Names, keys and identities as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import rules


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every blank at both ends, Unicode spaces included."""
    return F.btrim(col(c), F.lit(rules.WHITESPACE))


def text(c: Column | str) -> Column:
    """NULL becomes the empty string."""
    return F.coalesce(col(c), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate an expression once and use its result several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_name(c: Column | str) -> Column:
    """Industry name without its first sector note."""
    head = r"(?is)^(.*?)" + rules.SECTOR_NOTE
    return strip(F.regexp_replace(text(c), head, "$1"))


def raw_key(c: Column | str) -> Column:
    """Lower-case key on which cosmetic variants of a label meet."""
    key = F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and "))
    key = F.regexp_replace(F.translate(key, "/-–—_", " " * 5), r"[^a-z0-9 ]+", "")
    return F.trim(F.regexp_replace(key, r" +", " "))


def has_key(c: Column | str) -> Column:
    """Whether ``raw_key`` leaves anything of a text, without building the key."""
    return F.lower(text(c)).rlike(r"[a-z0-9&]")


def apply_aliases(key: Column, aliases: Mapping[str, str] = rules.CATEGORY_ALIASES) -> Column:
    """Replace listed keys; every other key stays as it is."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return let(key, lambda k: F.coalesce(F.try_element_at(table, k), k))


def norm_key(c: Column | str, aliases: Mapping[str, str] = rules.CATEGORY_ALIASES) -> Column:
    """Never NULL, and known to be: no join evaluates it a second time to test for that."""
    return text(apply_aliases(raw_key(c), aliases))


def family_of(
    key: Column | str,
    families: Sequence[tuple[str, str]] = rules.CATEGORY_FAMILIES,
    default: str = rules.DEFAULT_FAMILY,
) -> Column:
    """Family of a canonical key: the first pattern that occurs anywhere in it."""

    def first_match(k: Column) -> Column:
        (name, pattern), *rest = families
        out = F.when(k.rlike(pattern), name)
        for name, pattern in rest:
            out = out.when(k.rlike(pattern), name)
        return out.otherwise(default)

    return let(text(key), first_match)


def slug(c: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(dashed, r"^-|-$", ""), F.lit(80))


def hash16(c: Column | str) -> Column:
    return F.left(F.sha1(col(c)), F.lit(16))


def posting_id(
    url: Column | str = "url",
    victim: Column | str = "victim",
    group: Column | str = "group",
    attackdate: Column | str = "attackdate",
    domain: Column | str = "domain",
    country: Column | str = "country",
) -> Column:
    """The posting's URL, else a digest of its raw fields (blank fields keep their place)."""
    fields = F.concat_ws("|", *[text(c) for c in (victim, group, attackdate, domain, country)])
    return F.coalesce(F.nullif(col(url), F.lit("")), F.concat(F.lit("rw-"), hash16(fields)))


def incident_id(industry: Column | str, victim: Column | str) -> Column:
    return F.concat(slug(industry), F.lit("--"), slug(victim))


def year_of(c: Column | str) -> Column:
    head = F.left(text(c), F.lit(4))
    return F.when(head.rlike(r"^[0-9]{4}$"), head.try_cast("int"))


def sector_name(c: Column | str) -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(rules.UNCLASSIFIED_SECTOR))


def sector_key(c: Column | str) -> Column:
    return F.lower(strip(sector_name(c)))


def split_groups(c: Column | str, strip_first: bool = False) -> Column:
    """Attacker names listed in one text.

    The list is cut before notes in brackets are removed, so a separator inside
    brackets leaves a fragment; ``strip_first`` removes the notes beforehand.
    """
    note = r"\(.*?\)"
    source = F.regexp_replace(text(c), note, "") if strip_first else text(c)
    names = F.transform(
        F.split(source, r"[;,/]|\band\b"), lambda g: strip(F.regexp_replace(g, note, ""))
    )
    return F.filter(names, lambda g: (g != "") & (F.length(g) <= 60))


def clean_country(c: Column | str) -> Column:
    return strip(F.regexp_replace(text(c), r"\(.*?\)", ""))


def host_of(c: Column | str) -> Column:
    """Host of a URL in lower case without a leading ``www.``; '' for anything that is no URL."""
    host = F.regexp_extract(
        F.lower(text(c)),
        r"^\s*(?:https?:[/\\]*|[a-z][a-z0-9+.\-]*://)(?:[^/?#\\@]*@)?"
        r"(\[[0-9a-f:.]+\]|[^/?#\\@:\s<>^|%]+)(?=[:/?#\\]|\s*$)",
        1,
    )
    return F.regexp_replace(host, r"^www\.", "")


def is_url(c: Column | str, slashes: bool = False, any_case: bool = True) -> Column:
    pattern = ("(?i)" if any_case else "") + ("^https?://" if slashes else "^https?:")
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def company_key(c: Column | str) -> Column:
    """Organisation name without legal-form words, for exact matching."""
    words = F.regexp_replace(F.lower(text(c)), "(?U)" + rules.COMPANY_SUFFIX, " ")
    return F.trim(F.regexp_replace(words, r"[^a-z0-9]+", " "))


def org_key(c: Column | str) -> Column:
    return F.lower(strip(F.substring_index(text(c), " (", 1)))


def sector_slug(c: Column | str) -> Column:
    named = F.coalesce(F.nullif(col(c), F.lit("")), F.lit(rules.UNCLASSIFIED_FILE_SECTOR))
    return F.translate(F.lower(named), "/ ", "__")


def is_placeholder_group(c: Column | str) -> Column:
    return F.lower(strip(text(c))).isin(rules.PLACEHOLDER_GROUPS)


def is_placeholder_victim(c: Column | str) -> Column:
    name = strip(text(c))
    return (name == "") | name.rlike(rules.PLACEHOLDER_VICTIM)
