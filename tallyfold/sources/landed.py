"""Landed JSON texts as tables: explicit schemas, bad numbers to null, sentinels and defaults as stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.names import resolve_names

LINES = "struct<teams:struct<home:struct<players:map<string,struct<person:struct<id:bigint>,battingOrder:string,stats:map<string,string>>>>,away:struct<players:map<string,struct<person:struct<id:bigint>,battingOrder:string,stats:map<string,string>>>>>>"
CONTEXT = "struct<venue:struct<id:bigint,name:string>,dayNight:string,weather:struct<temp:string,wind:string,condition:string>>"
SCHEDULE = "struct<games:array<struct<gamePk:bigint,gameDate:string,home:struct<team:string,probable:string,lineup:array<struct<id:bigint>>>,away:struct<team:string,probable:string,lineup:array<struct<id:bigint>>>>>>"
SEASON = "struct<stats:array<struct<id:bigint,name:string,position:string,pa:string,avg:string,obp:string,slg:string,ops:string>>>"


def _players(df: DataFrame, unit: str, json: str) -> DataFrame:
    teams = df.select(unit, F.from_json(json, LINES).alias("j"))
    players = F.concat(*(F.coalesce(F.map_values(f"j.teams.{side}.players"), F.array()) for side in ("home", "away")))
    return teams.select(unit, F.explode(players).alias("p")).where("p.person.id is not null")


def unit_lines(df: DataFrame, unit: str, json: str, counts: list[str]) -> DataFrame:
    """One row for each player with trials: missing counts are 0, players without an id or without trials are left out."""
    rows = _players(df, unit, json).select(unit, F.col("p.person.id").alias("player_id"), *(F.coalesce(F.try_element_at("p.stats", F.lit(c)).try_cast("int"), F.lit(0)).alias(c) for c in counts))
    return rows.where(F.col(counts[0]) > 0)


def slots(df: DataFrame, unit: str, json: str) -> DataFrame:
    """slot = order div 100, starter where order mod 100 is 0; orders that are no number are left out."""
    rows = _players(df, unit, json).select(unit, F.col("p.person.id").alias("player_id"), F.col("p.battingOrder").try_cast("int").alias("order")).where("order is not null")
    return rows.select(unit, "player_id", F.floor(F.col("order") / 100).cast("int").alias("slot"), (F.col("order") % 100 == 0).cast("int").alias("starter"))


def context(df: DataFrame, unit: str, json: str) -> DataFrame:
    j = df.select(unit, F.from_json(json, CONTEXT).alias("j"))
    return j.select(unit, F.col("j.venue.id").alias("venue_id"), F.col("j.venue.name").alias("venue"), F.col("j.dayNight").alias("day_night"), F.col("j.weather.temp").try_cast("double").alias("temp"), F.col("j.weather.wind").alias("wind"))


def schedule(df: DataFrame, json: str) -> DataFrame:
    """One row for each game; lineups as arrays of ids, a missing starter is "TBD"."""
    g = df.select(F.explode(F.from_json(json, SCHEDULE)["games"]).alias("g"))

    def side(name: str) -> list[Column]:
        s = F.col(f"g.{name}")
        return [s["team"].alias(f"{name}_team"), F.coalesce(s["probable"], F.lit("TBD")).alias(f"{name}_probable"), F.coalesce(F.transform(s["lineup"], lambda p: p["id"]), F.array().cast("array<bigint>")).alias(f"{name}_lineup")]

    return g.select(F.col("g.gamePk").alias("game"), F.col("g.gameDate").cast("timestamp").alias("start"), *side("home"), *side("away"))


def season_table(df: DataFrame, json: str) -> DataFrame:
    """ops falls back to slg + obp, iso is slg - avg; incomplete rows and pitchers are left out (an unknown position stays)."""
    p = df.select(F.explode(F.from_json(json, SEASON)["stats"]).alias("p")).select("p.*")
    num = {c: F.col(c).try_cast("double") for c in ("pa", "avg", "obp", "slg", "ops")}
    p = p.withColumns(num).withColumns({"ops": F.coalesce("ops", F.col("slg") + F.col("obp")), "iso": F.col("slg") - F.col("avg")})
    return p.where("position is null or position != 'P'").dropna(subset=["id", "pa", "ops", "iso"])


def starters(games: DataFrame) -> DataFrame:
    """team -> the other side's starter."""
    return games.select(F.col("home_team").alias("team"), F.col("away_probable").alias("opponent")).union(games.select("away_team", "home_probable"))


def posted(games: DataFrame, now: Column) -> DataFrame:
    """Per game whether both lineups are there, unknown starters, and hours to the first start of all."""
    both = (F.size("home_lineup") > 0) & (F.size("away_lineup") > 0)
    first = games.agg(F.min("start").alias("first"))
    tbd = (F.col("home_probable") == "TBD").cast("int") + (F.col("away_probable") == "TBD").cast("int")
    hours = (F.unix_timestamp("first") - F.unix_timestamp(now)) / 3600
    return games.join(F.broadcast(first)).select("game", both.alias("posted"), tbd.alias("tbd"), hours.alias("hours_to_first"))


ROSTER = "struct<roster:array<struct<person:struct<id:bigint,fullName:string>,position:struct<abbreviation:string>>>>"


def roster(df: DataFrame, team: str, json: str, excluded: tuple[str, ...] = ("P",)) -> DataFrame:
    """team, player_id, name, position: people with an id whose position is not excluded (an unknown one stays)."""
    p = df.select(team, F.explode(F.from_json(json, ROSTER)["roster"]).alias("p"))
    rows = p.select(team, F.col("p.person.id").alias("player_id"), F.col("p.person.fullName").alias("name"), F.col("p.position.abbreviation").alias("position"))
    return rows.where("player_id is not null").where(F.coalesce(~F.col("position").isin(*excluded), F.lit(True)))


def probable_starters(games: DataFrame, people: DataFrame) -> DataFrame:
    """game, home_team, away_team and each side's probable starter by name and id; names split at their first space, unknown ones keep a null id."""

    def split(name: str) -> tuple[Column, Column]:
        cut = F.regexp_extract(name, "^([^ ]+) (.+)$", 1), F.regexp_extract(name, "^([^ ]+) (.+)$", 2)
        return tuple(F.when(F.col(name).contains(" "), c) for c in cut)

    out = games
    for side in ("home", "away"):
        first, last = split(f"{side}_probable")
        out = out.withColumns({f"_{side}_first": first, f"_{side}_last": last})
    wanted = out.select(F.col("_home_first").alias("first"), F.col("_home_last").alias("last")).union(out.select("_away_first", "_away_last"))
    ids = resolve_names(wanted.dropna(), people)
    for side in ("home", "away"):
        named = ids.select(F.col("first").alias(f"_{side}_first"), F.col("last").alias(f"_{side}_last"), F.col("id").alias(f"{side}_probable_id"))
        out = out.join(named, [f"_{side}_first", f"_{side}_last"], "left").drop(f"_{side}_first", f"_{side}_last")
    return out.select("game", "home_team", "away_team", "home_probable", "home_probable_id", "away_probable", "away_probable_id")
