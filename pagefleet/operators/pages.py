"""Site documents: calculator blocks, site meta, JSON-LD, sitemap, robots, pages.

C12 numeric_columns, I15 calculator_blocks, I17 site_meta, I18 json_ld,
B5 sitemap_lines (with H3), B6 robots_txt, B7 render_route_pages.

Documents that grow with the data (sitemaps, route pages) are produced as
ordered *lines* ``(doc, seq..., line)``: every data row renders its own line
in parallel and nothing is collected per document. ``sinks.containers``
range-partitions on the document and order keys, so one huge document is
split over several ordered part files instead of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefleet import schemas
from pagefleet.functions import scalar, text

# fixed values: document text of the templates
SITEMAP_HEAD = ('<?xml version="1.0" encoding="UTF-8"?>', '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">')
SITEMAP_FOOT = "</urlset>"
ROBOTS = "User-agent: *\nAllow: /\nSitemap: {sitemap}\n"
RESULT_LABEL = "Estimated Value"
SCHEMA_CONTEXT = "https://schema.org"

_NUMERIC_TYPE_RE = r"^(TINYINT|SMALLINT|INTEGER|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def numeric_columns(catalogue: DataFrame, n: int = schemas.CALCULATOR_INPUTS) -> DataFrame:
    """First ``n`` numeric columns of each dataset, in column order.

    ``catalogue``: ``dataset, ordinal, column_name, column_type`` (A3 output).
    Whole type names are matched (Q12: INTERVAL is not numeric).
    """
    w = Window.partitionBy("dataset").orderBy("ordinal")
    num = catalogue.filter(F.col("column_type").rlike(_NUMERIC_TYPE_RE))
    return num.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def calculator_blocks(catalogue: DataFrame, n: int = schemas.CALCULATOR_INPUTS) -> DataFrame:
    """Per dataset ``{base: 0, result_label, inputs: [{key, label, default: 1, weight: 1}]}``."""
    cols = numeric_columns(catalogue, n)
    inputs = cols.groupBy("dataset").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("ordinal"), F.col("column_name").alias("key"),
            text.label_from_key("column_name").alias("label"),
            F.lit(1).alias("default"), F.lit(1).alias("weight"),
        ))).alias("_inputs")
    )
    return inputs.select(
        "dataset",
        F.struct(
            F.lit(0).alias("base"), F.lit(RESULT_LABEL).alias("result_label"),
            F.transform("_inputs", lambda s: s.dropFields("ordinal")).alias("inputs"),
        ).alias("calculator"),
    )


def site_meta(sites: DataFrame, route_counts: DataFrame | None = None) -> DataFrame:
    """The per-site meta document as a struct column ``meta``.

    ``sites``: ``site, niche_id, target_dataset_url, template_type,
    monetization_pattern, seo_route_pattern, seo_high_volume_columns,
    seo_sample_routes, confidence, columns, calculator``; ``route_counts``:
    ``site, route_count``.
    """
    df = sites if route_counts is None else sites.join(route_counts, "site", "left")
    rc = F.coalesce(F.col("route_count"), F.lit(0)).cast("long") if route_counts is not None else F.lit(0).cast("long")
    meta = F.struct(
        F.col("niche_id"),
        text.title_from("niche_id").alias("title"),
        F.coalesce(F.col("target_dataset_url"), F.lit("")).alias("description"),
        F.col("template_type"),
        F.col("monetization_pattern"),
        text.canonical_base("niche_id").alias("canonical_base"),
        rc.alias("route_count"),
        F.struct(
            F.col("seo_route_pattern").alias("route_pattern"),
            F.coalesce("seo_high_volume_columns", F.array().cast("array<string>")).alias("high_volume_columns"),
            F.coalesce("seo_sample_routes", F.array().cast("array<string>")).alias("sample_routes"),
        ).alias("seo"),
        F.col("columns"),
        (F.col("monetization_pattern") == "local_lead_generation").alias("lead_gen"),
        F.lit("").alias("lead_webhook"),
        F.col("confidence"),
        F.col("calculator"),
        F.date_format(scalar.stamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("generated_at"),
    )
    return df.select("site", meta.alias("meta"))


def json_ld_route(title: Column, description: Column, n_items: Column) -> Column:
    """I18 (route page): schema.org ItemList with numberOfItems."""
    return F.to_json(F.struct(
        F.lit(SCHEMA_CONTEXT).alias("@context"), F.lit("ItemList").alias("@type"),
        title.alias("name"), description.alias("description"), n_items.alias("numberOfItems"),
    ))


def json_ld_index(title: Column, description: Column, base: Column, kind: str = "Dataset") -> Column:
    """I18 (index / calculator): Dataset or WebApplication; ``url`` only with a base."""
    desc = F.when(description.isNull() | (description == ""), title).otherwise(description)
    fields = [F.lit(SCHEMA_CONTEXT).alias("@context"), F.lit(kind).alias("@type"),
              title.alias("name"), desc.alias("description")]
    if kind == "WebApplication":
        fields.append(F.lit("BusinessApplication").alias("applicationCategory"))
    with_url = F.to_json(F.struct(*fields, base.alias("url")))
    without = F.to_json(F.struct(*fields))
    return F.when(base != "", with_url).otherwise(without)


def sitemap_lines(routes: DataFrame, sites: DataFrame, template: str = "template_type") -> DataFrame:
    """B5 (H3): sitemap lines ``site, section, rank_key, path_key, line`` for every site.

    ``/`` plus every route path (in rank order: row count desc, then path),
    each prefixed by the site's canonical base; the calculator theme lists
    only ``/``. ``routes``: ``site, path, row_count``; ``sites``: ``site,
    base, template_type``.
    """
    head = sites.select("site", F.posexplode(F.array(*[F.lit(h) for h in SITEMAP_HEAD])).alias("_o", "line")) \
        .select("site", F.lit(0).alias("_sec"), F.col("_o").cast("long").alias("_rc"), F.lit("").alias("_p"), "line")
    index = sites.select("site", F.lit(1).alias("_sec"), F.lit(0).cast("long").alias("_rc"), F.lit("").alias("_p"),
                         F.format_string("  <url><loc>%s/</loc></url>", "base").alias("line"))
    dirs = sites.filter(F.col(template) != "calculator").select("site", "base")
    body = routes.join(dirs, "site").select(
        "site", F.lit(2).alias("_sec"), (-F.col("row_count")).alias("_rc"), F.col("path").alias("_p"),
        F.format_string("  <url><loc>%s%s</loc></url>", "base", "path").alias("line"),
    )
    foot = sites.select("site", F.lit(3).alias("_sec"), F.lit(0).cast("long").alias("_rc"), F.lit("").alias("_p"),
                        F.lit(SITEMAP_FOOT).alias("line"))
    allrows = head.unionByName(index).unionByName(body).unionByName(foot)
    # Order keys instead of a per-site row number: no window over a site, the
    # writer range-partitions on (site, section, rank, path).
    return allrows.select("site", F.col("_sec").alias("section"), F.col("_rc").alias("rank_key"),
                          F.col("_p").alias("path_key"), "line")


def robots_txt(sites: DataFrame) -> DataFrame:
    """Allow-all robots file pointing at the sitemap (``/sitemap.xml`` without a base)."""
    sitemap = F.when(F.col("base") != "", F.concat(F.col("base"), F.lit("/sitemap.xml"))).otherwise(F.lit("/sitemap.xml"))
    return sites.select("site", F.format_string(ROBOTS.replace("{sitemap}", "%s"), sitemap).alias("body"))


def render_route_pages(routes: DataFrame, route_rows: DataFrame, columns: list[str], base: Column | str,
                       order_by: str | list[str], site: str | None = None) -> DataFrame:
    """Route pages as ordered HTML lines ``[site,] path, part, seq, line``.

    Head (title, description, canonical link, JSON-LD), the table header, one
    ``<tr>`` per data row in ``order_by`` order (null cells render empty,
    text is HTML-escaped) and the closing lines. Row lines are produced by the
    rows themselves, so a route with a third of all rows is rendered by all
    tasks; ``part`` 0/1/2 = head/body/foot, ``seq`` (the row's ``order_by``
    value for body lines) orders inside a part. One integer column gives a
    long ``seq``; any other order a struct of all its columns, null in the
    head and foot, behind the line number.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    keys = ["path"] if site is None else [site, "path"]
    fields = route_rows.select(*order).schema.fields
    if [f.dataType.typeName() for f in fields] in (["byte"], ["short"], ["integer"], ["long"]):
        line_seq, row_seq = (lambda i: i.cast("long")), F.col(order[0]).cast("long")
    else:
        line_seq = lambda i: F.struct(i.cast("long").alias("line"), *(
            F.lit(None).cast(f.dataType).alias(f"o{k}") for k, f in enumerate(fields)))
        row_seq = F.struct(F.lit(0).cast("long").alias("line"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))
    b = F.lit(base) if isinstance(base, str) else base
    canonical = text.canonical_url(b, F.col("path"))
    ld = json_ld_route(F.col("title"), F.col("description"), F.col("row_count"))
    header_cells = "".join(f"<th>{c}</th>" for c in columns)
    head_lines = F.array(
        F.lit("<!doctype html>"),
        F.lit('<html lang="en">'),
        F.lit("<head>"),
        F.concat(F.lit("<title>"), text.html_escape("title"), F.lit("</title>")),
        F.concat(F.lit('<meta name="description" content="'), text.html_escape("description"), F.lit('" />')),
        F.when(canonical != "", F.concat(F.lit('<link rel="canonical" href="'), canonical, F.lit('" />')))
        .otherwise(F.lit("")),
        F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>")),
        F.lit("</head>"),
        F.lit("<body>"),
        F.concat(F.lit("<h1>"), text.html_escape("title"), F.lit("</h1>")),
        F.concat(F.lit("<p>"), text.html_escape("description"), F.lit("</p>")),
        F.lit(f"<table><thead><tr>{header_cells}</tr></thead><tbody>"),
    )
    head = routes.select(*keys, F.posexplode(head_lines).alias("_i", "line")).select(
        *keys, F.lit(0).alias("part"), line_seq(F.col("_i")).alias("seq"), "line")
    foot = routes.select(*keys, F.lit(2).alias("part"), line_seq(F.lit(0)).alias("seq"),
                         F.lit("</tbody></table></body></html>").alias("line"))
    cells = [F.concat(F.lit("<td>"), text.html_escape(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))),
                      F.lit("</td>")) for c in columns]
    body = route_rows.select(
        *keys, F.lit(1).alias("part"), row_seq.alias("seq"),
        F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"),
    )
    return head.unionByName(body).unionByName(foot)


def render_index_pages(routes: DataFrame, sites: DataFrame) -> DataFrame:
    """B7 (index): each site's index page as ordered lines ``site, part, rank_key,
    path_key, line``: head (title, description, canonical, Dataset JSON-LD),
    a navigation list with one link per route (route order: size, then path),
    and the closing lines. ``routes``: ``site, path, title, row_count``;
    ``sites``: ``site, title, description, base``. One line per route, so a
    site's navigation is built by every task, never gathered.
    """
    desc = F.coalesce(F.col("description"), F.lit(""))
    ld = json_ld_index(F.col("title"), desc, F.col("base"))
    head_lines = F.array(
        F.lit("<!doctype html>"),
        F.lit('<html lang="en">'),
        F.lit("<head>"),
        F.concat(F.lit("<title>"), text.html_escape("title"), F.lit("</title>")),
        F.when(desc != "", F.concat(F.lit('<meta name="description" content="'), text.html_escape(desc),
                                    F.lit('" />'))).otherwise(F.lit("")),
        F.when(F.col("base") != "", F.concat(F.lit('<link rel="canonical" href="'), F.col("base"), F.lit('/" />')))
        .otherwise(F.lit("")),
        F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>")),
        F.lit("</head>"),
        F.lit("<body>"),
        F.concat(F.lit("<h1>"), text.html_escape("title"), F.lit("</h1>")),
        F.lit("<nav>"),
    )
    head = sites.select("site", F.posexplode(head_lines).alias("_i", "line")).select(
        "site", F.lit(0).alias("part"), F.col("_i").cast("long").alias("rank_key"), F.lit("").alias("path_key"), "line")
    nav = routes.select(
        "site", F.lit(1).alias("part"), (-F.col("row_count")).alias("rank_key"), F.col("path").alias("path_key"),
        F.concat(F.lit('<a href="'), text.html_escape("path"), F.lit('">'), text.html_escape("title"),
                 F.lit("</a>")).alias("line"))
    foot = sites.select("site", F.lit(2).alias("part"), F.lit(0).cast("long").alias("rank_key"),
                        F.lit("").alias("path_key"), F.lit("</nav></body></html>").alias("line"))
    return head.unionByName(nav).unionByName(foot)
