"""Pieces of DuckDB SQL for the oracles: adapters and key arithmetic, written out bit by bit."""

from __future__ import annotations

POINTS = """points AS (SELECT CAST((31*l_orderkey+7*l_linenumber)%256 AS INTEGER) AS x, CAST((17*l_partkey)%256 AS INTEGER) AS y,
 CAST((13*l_suppkey)%256 AS INTEGER) AS z, l_quantity AS val, l_linenumber AS w FROM lineitem)"""
MIXED = f"{POINTS}, mixed AS (SELECT x, y, z, 1 + w % 5 AS level FROM points)"
BOXES = """boxes AS (SELECT p_partkey AS box_id, CAST(37*p_partkey%240 AS INTEGER) AS bx, CAST(41*p_partkey%240 AS INTEGER) AS by_, CAST(43*p_partkey%240 AS INTEGER) AS bz,
 1+p_size%8 AS ex, 1+(p_size+3)%8 AS ey, 1+(p_size+5)%8 AS ez FROM part)"""
MM = "CASE WHEN event_type='error' THEN 0 ELSE CAST(400 + CAST(floor(value*100e0+0.5e0) AS BIGINT)%3600 AS INTEGER) END"
IMAGE = f"image AS (SELECT CAST(event_id%100 AS INTEGER) AS u, CAST(floor(event_id/100) AS INTEGER) AS v, {MM} AS mm FROM events)"
FRAMES = f"frames AS (SELECT CAST(event_id%4 AS INTEGER) AS frame, CAST((event_id//4)%50 AS INTEGER) AS u, CAST(event_id//200 AS INTEGER) AS v, {MM} AS mm FROM events)"
SECONDS = "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6)"
TRAJ = f"""gt AS (SELECT {SECONDS} AS stamp, value AS tx, CAST(user_id AS DOUBLE) AS ty, CAST(event_id%97 AS DOUBLE) AS tz FROM events WHERE event_type='view'),
est AS (SELECT {SECONDS} AS stamp, value AS tx, CAST(user_id AS DOUBLE) AS ty, CAST(event_id%97 AS DOUBLE) AS tz FROM events WHERE event_type='click')"""
RAYS = """rays AS (SELECT c_custkey AS ray_id, CAST(53*c_custkey%256 AS DOUBLE) AS ox, CAST(59*c_custkey%256 AS DOUBLE) AS oy, -10e0 AS oz,
 CAST(c_custkey%7-3 AS DOUBLE) AS dx, CAST(c_custkey%5-2 AS DOUBLE) AS dy, 5e0 AS dz FROM customer)"""


def morton(x: str, y: str, z: str, bits: int = 9) -> str:
    return "(" + " + ".join(f"((CAST({c} AS BIGINT) >> {i}) & 1) * {1 << 3 * i + k}" for i in range(bits) for k, c in enumerate((x, y, z))) + ")"


def cut(code: str, level: str, depth: int = 8) -> str:
    return f"({code} - {code} % (CAST(1 AS BIGINT) << CAST(3*({depth}-({level})) AS INTEGER)))"


def key(x: str, y: str, z: str, level: str, depth: int = 8) -> str:
    side = f"(1 << CAST({depth}-({level}) AS INTEGER))"
    return f"({morton(*(f'({c} - {c} % {side})' for c in (x, y, z)))} + ({level}))"


def block(x: str = "x", y: str = "y", z: str = "z") -> str:
    return key(x, y, z, "5")


SLOT = "CAST(x%8 + 8*(y%8) + 64*(z%8) AS INTEGER)"
