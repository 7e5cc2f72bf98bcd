"""Declared schemas of feeds, items, matches, standings and the warehouse."""

from __future__ import annotations

FEED_CONFIG = "name string, url string, reliability int, language string, official boolean"
EXTERNAL_ARTICLE = "externalId string, url string, title string, excerpt string, author string, imageUrl string, publishedAt string"
MATCH = "id string, competition string, home string, away string, home_score int, away_score int, start_time string, status string, minute int, venue string, start string"
STANDING = "position int, team string, played int, won int, drawn int, lost int, goal_difference int, points int, form array<string>"
TEAM = "id string, name string, short_name string, slug string, country string, venue string"

API_FIXTURES = (
    "response array<struct<fixture:struct<id:long,date:string,status:struct<short:string,elapsed:int>,venue:struct<name:string>>,league:struct<id:long,name:string>,"
    "teams:struct<home:struct<name:string>,away:struct<name:string>>,goals:struct<home:int,away:int>>>"
)
DATA_MATCHES = (
    "matches array<struct<id:long,utcDate:string,status:string,minute:int,venue:string,competition:struct<code:string,name:string>,"
    "homeTeam:struct<name:string,shortName:string,tla:string>,awayTeam:struct<name:string,shortName:string,tla:string>,"
    "score:struct<fullTime:struct<home:int,away:int,homeTeam:int,awayTeam:int>>>>"
)
DATA_STANDINGS = (
    "standings array<struct<type:string,`table`:array<struct<position:int,team:struct<name:string,shortName:string,tla:string>,playedGames:int,won:int,draw:int,"
    "lost:int,goalDifference:int,points:int,form:string>>>>"
)

API_STANDINGS = (
    "response array<struct<league:struct<standings:array<array<struct<rank:int,team:struct<name:string>,points:int,goalsDiff:int,form:string,"
    "all:struct<played:int,win:int,draw:int,lose:int>>>>>>>"
)
API_TEAMS = "response array<struct<team:struct<id:long,name:string,code:string,country:string>,venue:struct<name:string>>>"
DATA_TEAMS = "teams array<struct<id:long,name:string,shortName:string,tla:string,area:struct<name:string>,venue:string>>"
