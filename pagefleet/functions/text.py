"""Text functions: slugs, titles, route text, URL extraction (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefleet import schemas

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def route_slug(c: ColumnOrName) -> Column:
    """Lower-case, runs of non ``[a-z0-9]`` become ``-``, strip ``-`` (may be '')."""
    return F.btrim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def site_slug(c: ColumnOrName, fallback: str = "site") -> Column:
    """As route_slug, empty or null becomes ``fallback``."""
    return F.coalesce(F.nullif(route_slug(c), F.lit("")), F.lit(fallback))


def project_slug(c: ColumnOrName, fallback: str = "site", max_len: int = schemas.PROJECT_SLUG_MAX) -> Column:
    """As route_slug, cut to ``max_len`` chars, strip ``-`` again, empty -> fallback."""
    cut = F.btrim(F.substring(route_slug(c), 1, max_len), F.lit("-"))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(fallback))


def title_case(c: ColumnOrName) -> Column:
    """Python ``str.title()``: capitalise the first letter after every non-letter.

    ``initcap`` only splits on spaces (``b2b`` -> ``B2b``); here the text is cut
    into letter runs and non-letter runs and each letter run is capitalised.
    """
    runs = F.regexp_extract_all(_col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def title_from(c: ColumnOrName, default_title: str = "Data Site") -> Column:
    """I4: ``_`` and ``-`` become spaces, then title case; null/empty -> default."""
    col = _col(c)
    spaced = F.translate(col, "_-", "  ")
    return F.when(col.isNull() | (col == ""), F.lit(default_title)).otherwise(title_case(spaced))


def label_from_key(c: ColumnOrName) -> Column:
    """I15 label: ``_`` becomes space, then title case."""
    return title_case(F.translate(_col(c), "_", " "))


def build_name(niche: ColumnOrName, evaluation_id: ColumnOrName, site_id: ColumnOrName) -> Column:
    """``{slug}-e{eval}-s{site}``; a missing niche falls back to ``evaluation-{id}``."""
    niche_or = F.coalesce(
        F.nullif(_col(niche), F.lit("")),
        F.concat(F.lit("evaluation-"), _col(evaluation_id).cast("string")),
    )
    return F.format_string("%s-e%s-s%s", site_slug(niche_or), _col(evaluation_id), _col(site_id))


def project_base(niche: ColumnOrName, build_path: ColumnOrName, site_id: ColumnOrName,
                 fallback_prefix: str = "site-") -> Column:
    """Niche slug, else build dir name without ``-e<n>-s<n>``, else ``{prefix}{id}``."""
    niche_c = _col(niche)
    dir_name = F.regexp_extract(_col(build_path), r"([^/]*)/*$", 1)
    base = F.regexp_replace(dir_name, r"-e[0-9]+-s[0-9]+$", "")
    return (
        F.when(niche_c.isNotNull() & (niche_c != ""), project_slug(niche_c))
        .when(base.isNotNull() & (base != ""), project_slug(base))
        .otherwise(F.concat(F.lit(fallback_prefix), _col(site_id).cast("string")))
    )


def canonical_base(niche: ColumnOrName, host_suffix: str = ".pages.dev") -> Column:
    """``https://{slug}{host_suffix}`` using the uncut slug; '' without a niche (Q14)."""
    niche_c = _col(niche)
    return F.when(
        niche_c.isNotNull() & (niche_c != ""),
        F.concat(F.lit("https://"), site_slug(niche_c), F.lit(host_suffix)),
    ).otherwise(F.lit(""))


def canonical_url(base: ColumnOrName, path: ColumnOrName) -> Column:
    """I7 page form: base + path, '' when there is no base."""
    b = _col(base)
    return F.when(b != "", F.concat(b, _col(path))).otherwise(F.lit(""))


def route_label(values: list[Column]) -> Column:
    """I13 label: the key texts joined by `` · ``."""
    return F.concat_ws(" · ", *values)


def route_title(label: Column, niche_title: Column | str | None) -> Column:
    """I13 title: ``{label} — {niche}``, or the label alone without a niche title."""
    nt = F.lit(niche_title) if isinstance(niche_title, str) or niche_title is None else niche_title
    return F.when(nt.isNotNull() & (nt != ""), F.concat(label, F.lit(" — "), nt)).otherwise(label)


def route_description(label: Column, row_count: Column, niche_title: Column | str | None) -> Column:
    """I13 description: ``{niche}: {label}. {n} matching record(s).``."""
    nt = F.lit(niche_title) if isinstance(niche_title, str) or niche_title is None else niche_title
    tail = F.concat(label, F.lit(". "), row_count.cast("string"), F.lit(" matching record(s)."))
    return F.when(nt.isNotNull() & (nt != ""), F.concat(nt, F.lit(": "), tail)).otherwise(tail)


def extract_pages_url(c: ColumnOrName, pattern: str = schemas.PAGES_DEV_PATTERN) -> Column:
    """First ``https://<host>.pages.dev`` URL in a log text, else ''."""
    return F.regexp_extract(_col(c), pattern, 0)


def first_non_empty(*cols: ColumnOrName, default: str = "unknown-dataset") -> Column:
    """First value that is neither null nor '' (falsy values fall through)."""
    return F.coalesce(*[F.nullif(_col(c).cast("string"), F.lit("")) for c in cols], F.lit(default))


def error_summary(errors: ColumnOrName) -> Column:
    """``loc: msg`` entries joined with ``; ``; empty array -> null."""
    arr = _col(errors)
    return F.when(F.size(arr) > 0, F.array_join(arr, "; "))


def html_escape(c: ColumnOrName) -> Column:
    """Escape ``& < > "`` for HTML text and attribute values."""
    out = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def is_blank(c: ColumnOrName) -> Column:
    """C6 test: null, or only whitespace in Python's sense (``str.strip() == ''``)."""
    col = _col(c)
    return col.isNull() | col.cast("string").rlike(r"(?U)^[\s\x1c-\x1f]*$")
