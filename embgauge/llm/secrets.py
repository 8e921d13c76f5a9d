"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns find assignments, access keys and hexadecimal runs. Every found value and every other long mixed
token is a candidate; candidates are counted by value over the whole corpus: how many repositories and owners hold
it. A value that many owners or many repositories hold is a copied example; one that a single owner holds in few
repositories looks live. Candidates without a base pattern become spans of their own if they look live.
"""

from pyspark.sql import Column, DataFrame, functions as F

from embgauge.llm.shared import stored

# Patterns of the base kinds, in the order of the kinds, with the least length of the value.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 8
#: AKIA and a run of capitals and digits, 16 characters or more in all; a match of fewer holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{12,}"
#: Maximal runs, 32 characters or more.
HEX = r"[0-9a-f]{32,}"
#: Tokens that may be secrets without a base pattern: 20 characters or more, with letters of both cases and digits.
LOOSE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")

SPAN = "struct<start:int,order:int,kind:string,stop:int,value:string>"


def _found(text: Column, pattern: str, kind: str, value=lambda m: m, keep=lambda m: F.lit(True)) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points.

    The text is what lies between matches and the matches in turn, so a match starts after the lengths before it.
    """
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    order = KINDS.index(kind)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(state, match):
        start = state["at"] + F.length(F.element_at(between, state["i"] + 1))
        stop = start + F.length(match)
        span = F.struct(
            start.alias("start"),
            F.lit(order).alias("order"),
            F.lit(kind).alias("kind"),
            stop.alias("stop"),
            F.sha2(value(match), 256).alias("value"),
        )
        out = F.when(keep(match), F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(stop.alias("at"), (state["i"] + 1).alias("i"), out.alias("out"))

    return F.aggregate(matches, zero, step, lambda s: s["out"])


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _joined(spans: Column) -> Column:
    """``kind:start:stop`` by start, then kind, comma-joined."""
    named = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return F.array_join(named, ",")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
    copied_owners: int = 3,
    copied_repositories: int = 10,
) -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_owned, n_copied, n_live, most_owners, most_repositories, base, spans)`` for
    every row of ``docs``.

    ``base`` and ``spans`` list ``kind:start:stop`` in code points, stop exclusive, by start and then kind. ``spans``
    has the base spans and ``owned`` ones: loose tokens outside them whose value is live. ``n_copied`` counts spans, loose
    tokens included, whose value ``copied_owners`` owners or more hold, or ``copied_repositories`` repositories or more;
    ``n_live`` those that one owner holds in fewer repositories. ``most_owners`` and ``most_repositories`` are the
    largest counts of any value of the row, 0 if it has none.

    Null and empty texts hold nothing. A null owner or repository is one of its own. Repeated rows count each in the
    result and once in the frequencies. A row with a null id gets its spans like any other. Of other columns none
    is read. Values leave the scan as digests only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    group2 = lambda m: F.regexp_extract(m, ASSIGN, 2)
    when = lambda test, found: F.when(test, found).otherwise(_none())
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.col(text_col).cast("string").alias("text"),
    )
    loose_keep = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    found = rows.select(
        "id",
        "repository",
        "owner",
        when(
            text.rlike(ASSIGN),
            _found(text, ASSIGN, "assign", group2, lambda m: F.length(group2(m)) >= ASSIGN_LEAST),
        ).alias("assign"),
        when(text.contains("AKIA"), _found(text, ACCESS, "access")).alias("access"),
        when(text.rlike(HEX), _found(text, HEX, "hex")).alias("hex"),
        when(text.rlike(LOOSE), _found(text, LOOSE, "owned", keep=loose_keep)).alias("loose"),
    )
    base = F.concat("assign", "access", "hex")
    apart = F.filter("loose", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    found = found.select("id", "repository", "owner", base.alias("base"), "loose").select(
        "id", "repository", "owner", "base", apart.alias("loose"), F.monotonically_increasing_id().alias("row")
    )
    found = stored(found)

    # a copied value is one row for each owner and repository of a task before it moves
    seen = found.select("repository", "owner", F.explode(F.concat("base", "loose")).alias("s"))
    seen = seen.select(F.col("s.value").alias("value"), "repository", "owner")
    held = seen.groupBy("value").agg(
        F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")
    )
    spans = found.select("row", F.explode(F.concat("base", "loose")).alias("s")).select("row", "s", F.col("s.value").alias("value"))
    copied = (F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)
    live = (F.col("owners") == 1) & (F.col("repositories") < copied_repositories)
    judged = spans.join(held, "value").groupBy("row").agg(
        F.collect_list(F.when((F.col("s.order") == 3) & live, F.col("s"))).alias("owned"),
        F.count_if(copied).alias("n_copied"),
        F.count_if(live).alias("n_live"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    out = found.join(judged, "row", "left")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    owned = F.coalesce("owned", _none())
    return out.select(
        "id",
        *[n(k) for k in KINDS[:3]],
        F.size(owned).cast("long").alias("n_owned"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "most_owners", "most_repositories")],
        _joined(F.col("base")).alias("base"),
        _joined(F.concat("base", owned)).alias("spans"),
    )
