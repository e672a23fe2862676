"""Entity resolution, dimensions and derived attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ordered family keyword rules; the first family with a hit wins.
FAMILY_RULES = (
    ("player", ("GOALLEADER", "TEAMLEADGOAL", "PLAYERGOALS", "WCAST", "WCSOA", "HATTRICK", "AWARD", "GBOOTGOALS", "GOLDENBOOTCLEAT", "GOALCOMBO", "GOALSTREAK", "FIFATOP10", "SQUAD", "MESSIMBAPPE", "MESSIRONALDO", "MBAPPEGOALLEADER")),
    ("group", ("GROUPWIN", "WINGROUP", "GROUPQUAL", "GROUPORDER", "GROUPBOTTOM", "GROUPPTS", "GROUPGOALS", "GSGOALS", "3RDPLACEQUAL", "GSUNDEFEATED", "GS3WINS")),
    ("team_performance", ("STAGEOFELIM", "WCROUND", "WCSTAGE", "REGIONKO", "FURTHESTADVANCING", "USAOPPONENT", "TEAMTOTALGOALS", "GOALSALLOWED", "TEAMH2H", "WCCONGO", "WCIRAN", "WCADVANCE", "HOSTKO", "HOSTSTAGE", "BESTHOST", "HOSTWIN", "WCHOST")),
    ("winner", ("FINALMATCHUP", "3RDPLACE", "CONTINENT", "1STTIMEWIN", "NOEURSA", "FINISHINGORDER")),
    ("per_match", ("WCGAME", "SPREAD", "WCTOTAL", "SCORE", "BTTS", "WC1H", "WC2H", "WCMOV", "WINMARGIN", "TTSF", "FTTS", "CONCEDE1ST", "WCMOF", "CORNERS", "SHOT", "SOG", "SAVE", "GOALCOUNT", "START", "MATCHUP", "WCPLAY", "TEAMSINGAME", "TEAMTOTAL", "TEAMGOALS", "TEAM1STGOAL", "TEAMFIRSTGOAL", "FIRSTGOAL")),
    ("novelty", ("TOTALGOAL", "FASTESTGOAL", "GAMEGOALS", "GOALEVERYGAME", "EVERYTEAMGOAL", "KOPENALTIES", "LONGESTPEN", "GOALIEGOAL", "GOALIEPEN", "OLIMPICO", "FREEKICKGOAL", "RECORD", "WINNERTRAIL", "DELAY", "LOCATION", "FIRSTSONG", "PREPACK", "CLUBGOALS", "WCGOAL")),
    ("off_pitch", ("WCADS", "WCPRICE", "FINALSONGS", "WCATTEND", "OCUSA", "OCMEX", "OCCAN", "VIEWERSHIP", "WCUPSONG", "WCSONG", "WCMENTION", "TRUMPWORLDCUP", "FIFATRAVEL", "FIFAPEACE", "TRUMPHANDSHAKE", "WCDEAL", "PERSONATTENDTRUMP")),
)
#: The nine family codes of the export, in code order.
FAMILY_CODES = ("winner_futures", "match_3way", "advancement", "spread_total_score", "group", "stage_elimination", "golden_boot", "host_novelty_prop", "other")
#: Fate codes, in code order.
FATE_CODES = ("settled_no", "settled_yes", "voided", "alive_at_freeze")
#: Parts that a key's markets and a team's eliminations are dealt to where every one meets every other.
DEALS = 64
#: Parts that a team's eliminations are collected in, and the rows of a list that a part is cut into.
SLICES, RUN = 16, 256
NON_TEAM_SUFFIXES = ("TIE", "YES", "NO", "OVER", "UNDER")
KEY_PATTERN = r"^([A-Z0-9]+)-(\d{2})([A-Z]{3}\d{2})([A-Z0-9]{3})([A-Z0-9]{3})$"


def parse_event(df: DataFrame, key: str = "event_ticker") -> DataFrame:
    """``PREFIX-YYMMMDDC1C2`` to prefix, date part and two codes."""
    part = lambda i: F.regexp_extract(key, KEY_PATTERN, i)
    return df.withColumn("prefix", part(1)).withColumn("date_part", part(3)).withColumn("code1", part(4)).withColumn("code2", part(5))


def crosswalk(df: DataFrame, names: DataFrame, venues: Sequence[str]) -> DataFrame:
    """Both codes of a match to canonical and venue names (E02). ``names``: code and venue columns."""
    out = df
    for i in (1, 2):
        side = names.select(F.col("code").alias(f"code{i}"), *[F.col(v).alias(f"team{i}_{v}") for v in venues])
        out = out.join(side, f"code{i}", "left")
    return out


def match_pairs(a: DataFrame, b: DataFrame, a1: str, a2: str, b1: str, b2: str, value: str, out: str) -> DataFrame:
    """Partner of each pair in either order, same order first (E03): two equi joins, no OR."""
    one = b.groupBy(F.col(b1).alias("__p"), F.col(b2).alias("__q")).agg(F.min(value).alias("__v"))
    same = one.select(F.col("__p").alias(a1), F.col("__q").alias(a2), F.col("__v").alias("__same"))
    turned = one.select(F.col("__q").alias(a1), F.col("__p").alias(a2), F.col("__v").alias("__turned"))
    j = a.join(same, [a1, a2], "left").join(turned, [a1, a2], "left")
    return j.withColumn(out, F.coalesce("__same", "__turned")).withColumn(f"{out}_found", F.col(out).isNotNull()).drop("__same", "__turned")


def match_results(legs: DataFrame) -> DataFrame:
    """Regulation result, advancing side, status and whether play went on.

    ``legs``: match_id, kind (regulation or advance), code, side (1, 2 or 0 for a tie), result.
    """
    won = F.col("result") == "yes"
    reg, adv = F.col("kind") == "regulation", F.col("kind") == "advance"
    code = lambda k, s: F.max(F.when(k & won & (F.col("side") == s), F.col("code")))
    tie = F.max(F.when(reg & won & (F.col("side") == 0), F.lit("TIE")))
    g = legs.groupBy("match_id").agg(F.coalesce(tie, code(reg, 1), code(reg, 2)).alias("regulation"), F.coalesce(code(adv, 1), code(adv, 2)).alias("advance"))
    return g.withColumn("status", F.when(F.col("regulation").isNull(), "scheduled").otherwise("finalized")).withColumn(
        "beyond_regulation", F.coalesce(F.col("regulation") == "TIE", F.lit(False))
    )


def entity_map(matches: DataFrame, results: DataFrame, venue: DataFrame, fixtures: DataFrame) -> DataFrame:
    """One row per match with every id; ``unmappable`` when a source has no partner."""
    j = matches.join(results, "match_id", "left").join(venue, "match_id", "left").join(fixtures, "match_id", "left")
    return j.withColumn("unmappable", F.col("venue_id").isNull() | F.col("fixture_id").isNull())


def override_join(a: DataFrame, b: DataFrame, key: str, overrides: DataFrame) -> DataFrame:
    """Left join on a name after explicit overrides (E06). ``overrides``: name, use."""
    o = overrides.select(F.col("name").alias(key), F.col("use").alias("__use"))
    keyed = a.join(o, key, "left").withColumn("__k", F.coalesce("__use", key)).drop("__use")
    return keyed.join(b.withColumnRenamed(key, "__k"), "__k", "left").drop("__k")


def normal_name(c: Column) -> Column:
    """Lower case, trimmed, tokens in alphabetical order."""
    return F.array_join(F.array_sort(F.split(F.lower(F.trim(c)), r"\s+")), " ")


def norm_name_join(a: DataFrame, b: DataFrame, a_name: str, b_name: str, aliases: DataFrame) -> DataFrame:
    """Join on normalised names with an alias table (E07). ``aliases``: name, alias (lower case)."""
    al = aliases.select(F.lower("name").alias("__l"), F.col("alias").alias("__a"))
    left = a.withColumn("__l", F.lower(F.trim(a_name))).join(al, "__l", "left").withColumn("__n", normal_name(F.coalesce("__a", "__l"))).drop("__l", "__a")
    right = b.withColumn("__n", normal_name(F.col(b_name)))
    return left.join(right, "__n", "left").drop("__n")


def market_ref(m: DataFrame, series: DataFrame) -> DataFrame:
    """Markets with their series' attributes."""
    return m.join(series, "series_ticker", "left")


def classify(df: DataFrame, text: str, rules: Sequence[tuple[str, Sequence[str]]] = FAMILY_RULES, default: str = "other", out: str = "family", exact: Mapping[str, str] | None = None) -> DataFrame:
    """The family that ``exact`` gives the whole text, else the first whose keyword occurs in it.

    ``exact`` holds the named tickers first and then the known family of each listed one, merged by the caller."""
    expr = None
    for family, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.col(text), F.lit(w))
        expr = F.when(hit, family) if expr is None else expr.when(hit, family)
    found = F.lit(default) if expr is None else expr.otherwise(default)
    if exact:
        found = F.coalesce(_lookup(exact, F.col(text), None), found)
    return df.withColumn(out, found)


def family_enum(df: DataFrame, family: str, series: str, direct: Mapping[str, str], per_match: str, split: Mapping[str, str], per_match_rest: str, out: str = "family_code") -> DataFrame:
    """Family text to its code; the per-match family splits by series."""
    name = F.when(F.col(family) == per_match, _lookup(split, F.col(series), per_match_rest)).otherwise(_lookup(direct, F.col(family), "other"))
    codes = F.array(*[F.lit(c) for c in FAMILY_CODES])
    return df.withColumn(out, (F.array_position(codes, name) - 1).cast("int"))


def _lookup(m: Mapping[str, str], key: Column, default: str | None) -> Column:
    pairs = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def team_index(df: DataFrame, ticker: str, series: str, team_series: DataFrame, codes: DataFrame) -> DataFrame:
    """Team number from a ticker's last part, through either code system; 0 otherwise.

    ``team_series``: series; ``codes``: code, idx, one row per accepted spelling.
    """
    suffix = F.element_at(F.split(ticker, "-"), -1)
    d = df.withColumn("__s", suffix).join(team_series.select(F.col("series").alias(series)).distinct().withColumn("__t", F.lit(True)), series, "left")
    d = d.join(codes.select(F.col("code").alias("__s"), F.col("idx").alias("__i")), "__s", "left")
    keep = F.col("__t") & ~F.col("__s").isin(*NON_TEAM_SUFFIXES)
    return d.withColumn("team_idx", F.when(keep, F.coalesce("__i", F.lit(0))).otherwise(0)).drop("__s", "__t", "__i")


def fate(df: DataFrame, status: str = "status", result: str = "result") -> DataFrame:
    """Settled yes or no, voided, or still alive."""
    s, r = F.col(status), F.col(result)
    name = (
        F.when((s == "finalized") & (r == "yes"), "settled_yes")
        .when((s == "finalized") & (r == "no"), "settled_no")
        .when(s.isin("finalized", "closed", "inactive"), "voided")
        .otherwise("alive_at_freeze")
    )
    code = F.array_position(F.array(*[F.lit(c) for c in FATE_CODES]), name) - 1
    return df.withColumn("fate", name).withColumn("fate_code", code.cast("int"))


def legs(em: DataFrame, columns: Mapping[str, Mapping[str, str]], result: str = "regulation") -> DataFrame:
    """Match to one row per leg.

    ``columns``: leg name to {output column: match column}, the winner's code among them as ``code``.
    """
    items = [F.struct(F.lit(leg).alias("leg"), *[F.col(src).alias(dst) for dst, src in cols.items()]) for leg, cols in columns.items()]
    out = em.withColumn("__l", F.explode(F.array(*items))).select("match_id", result, "__l.*")
    return out.withColumn("outcome", F.when(F.col(result).isNull(), F.lit(None)).otherwise((F.col(result) == F.col("code")).cast("int")))


def targets(legs_df: DataFrame, horizons: Mapping[str, int], resolved: str) -> DataFrame:
    """Legs by horizons before resolution (E14); the short list is a literal array."""
    hs = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(s).cast("long").alias("back")) for n, s in horizons.items()])
    x = legs_df.withColumn("__h", F.explode(hs))
    return x.select(*legs_df.columns, "__h.horizon", (F.col(resolved) - F.col("__h.back")).alias("target_ts"))


def eliminations(em: DataFrame, m: DataFrame) -> DataFrame:
    """Loser of each match and when its progression leg settled.

    ``em``: match_id, code1, code2, advance. ``m``: match_id, code, settle_ts of progression legs.
    """
    loser = F.when(F.col("advance") == F.col("code1"), F.col("code2")).when(F.col("advance") == F.col("code2"), F.col("code1"))
    lost = em.where("advance is not null").select("match_id", loser.alias("loser")).where("loser is not null")
    return lost.join(m.select("match_id", F.col("code").alias("loser"), F.col("settle_ts").alias("elim_ts")), ["match_id", "loser"])


def team_props(elim: DataFrame, series: Sequence[str], m: DataFrame, year: str) -> DataFrame:
    """Every prop market of an eliminated team (E16): team by series names equal an event key.

    A team has many markets and many eliminations, and the result has a row for each two. The teams are few, so markets
    are dealt to ``DEALS`` parts of their team, and a part meets its eliminations in lists of ``RUN``. Only the written
    rows are many, and a list is written for one market after another, so columns repeat at short range and files stay
    small. The lists are small too, so the tasks are those of a shuffle whatever its size.
    """
    tasks = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = elim.groupBy("loser", F.pmod(F.xxhash64("elim_ts"), F.lit(SLICES)).alias("__slice")).agg(F.collect_list(F.struct("elim_ts")).alias("__all"))
    slices = slices.select(F.col("loser").alias("team"), F.col("__all.elim_ts").alias("__all"))
    starts = F.sequence(F.lit(1), F.size("__all"), F.lit(RUN))
    lists = slices.select("team", F.explode(F.transform(starts, lambda i: F.slice("__all", i, F.lit(RUN)))).alias("__at"))
    lists = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)).cast("array<bigint>")).alias("__deal"))
    event, heads = F.col("event_ticker"), [f"{name}-{year}" for name in series]
    teams = F.array_compact(F.array(*[F.when(event.startswith(h), F.substring(event, len(h) + 1, 2**31 - 1)) for h in heads]))
    deal = F.pmod(F.xxhash64("ticker"), F.lit(DEALS)).alias("__deal")
    dealt = m.select(F.explode(F.transform(teams, lambda t: F.struct(t.alias("team"), "ticker", deal))).alias("__m")).select("__m.*")
    # Lists first: a sort-merge join reads its left side once and repeats the markets for each list.
    met = lists.repartition(tasks, "team", "__deal").join(dealt.repartition(tasks, "team", "__deal"), ["team", "__deal"])
    return met.select("team", "ticker", F.explode("__at").alias("elim_ts"))


def resolution(m: DataFrame) -> DataFrame:
    """Settlement time, else close time."""
    at = F.coalesce(F.try_to_timestamp(F.col("settlement_ts")), F.try_to_timestamp(F.col("close_time")))
    return m.withColumn("resolution_ts", F.unix_seconds(at))


def winners(m: DataFrame, t: DataFrame, floor: float = 0.98) -> DataFrame:
    """Winner per match: the catalog's, else the side whose last price reached the floor, else both
    provisionally (E18). ``m``: match_id, ticker, side, status, result.
    """
    last = t.groupBy("ticker").agg(F.max_by("yes_price_usd", F.struct("created_ts", "trade_id")).alias("last_price"))
    j = m.join(last, "ticker", "left")
    settled = (F.col("status") == "finalized") & (F.col("result") == "yes")
    g = j.groupBy("match_id").agg(
        F.min(F.when(settled, F.col("side"))).alias("by_result"),
        F.min(F.when(F.col("last_price") >= floor, F.col("side"))).alias("by_price"),
        F.array_join(F.array_sort(F.collect_set("side")), "/").alias("both"),
    )
    basis = F.when(F.col("by_result").isNotNull(), "catalog").when(F.col("by_price").isNotNull(), "price").otherwise("provisional")
    return g.select("match_id", F.coalesce("by_result", "by_price", "both").alias("winner"), basis.alias("basis"))


def top_terminal(t: DataFrame, legs_df: DataFrame, by: str, label: str) -> DataFrame:
    """Leg with the highest last price among exclusive ones."""
    last = t.groupBy("ticker").agg(F.max_by("yes_price_usd", F.struct("created_ts", "trade_id")).alias("p"))
    j = legs_df.join(last, "ticker")
    return j.groupBy(by).agg(F.max_by(label, F.struct(F.col("p"), F.col(label))).alias("method"), F.max("p").alias("last_price"))


def labels(m: DataFrame, names: DataFrame) -> DataFrame:
    """Readable title and settlement label from key fields (E20). ``m``: ticker, fate, sub_title."""
    code = F.element_at(F.split("ticker", "-"), -1)
    j = m.withColumn("__c", code).join(names.select(F.col("code").alias("__c"), F.col("name").alias("__n")), "__c", "left")
    team = F.coalesce("__n", F.initcap(F.lower("__c")))
    title = F.when(F.col("__c") == "TIE", "Draw").otherwise(F.concat(team, F.lit(" to win")))
    settle = F.when(F.col("fate") == "settled_yes", "Settled yes").when(F.col("fate") == "settled_no", "Settled no").when(F.col("fate") == "voided", "Voided").otherwise("Open")
    return j.withColumn("title", F.coalesce(F.nullif(F.trim("sub_title"), F.lit("")), title)).withColumn("settle_label", settle).drop("__c", "__n")


def flags(df: DataFrame, key: str, sets: Sequence[DataFrame]) -> DataFrame:
    """Bit i is set when the key is in the i-th set."""
    out, bits = df, F.lit(0)
    for i, s in enumerate(sets):
        out = out.join(s.select(key).distinct().withColumn(f"__f{i}", F.lit(1 << i)), key, "left")
        bits = bits.bitwiseOR(F.coalesce(f"__f{i}", F.lit(0)))
    return out.withColumn("flags", bits).drop(*[f"__f{i}" for i in range(len(sets))])


def match_id(df: DataFrame, key: str = "event_ticker", out: str = "match_id") -> DataFrame:
    """Match key without its family prefix and year."""
    return df.withColumn(out, F.regexp_replace(key, r"^[A-Z0-9]+-\d{2}", ""))


def rewrite_family(df: DataFrame, key: str, old: str, new: str, out: str) -> DataFrame:
    """The same match's key in another family."""
    return df.withColumn(out, F.regexp_replace(key, "^" + old + "-", new + "-"))


def pick_token(df: DataFrame, column: str, i: int, out: str) -> DataFrame:
    """The i-th element of a list stored as JSON text."""
    return df.withColumn(out, F.get(F.from_json(column, "array<string>"), i))
