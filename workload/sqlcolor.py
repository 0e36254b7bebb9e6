"""SQL spellings of the colour rules, for the oracle side only."""

from __future__ import annotations

from voxelspark.functions import color as c

RGB = "rgb"


def byte(e: str) -> str:
    return f"CAST(floor(({e})+0.5e0) AS INTEGER)"


def clamp8(e: str) -> str:
    return f"(CASE WHEN ({e})<=0 THEN 0 WHEN ({e})>=255 THEN 255 ELSE {byte(e)} END)"


def lerp(a: str, b: str, t: str) -> str:
    return f"(CASE WHEN ({t})<=0 THEN ({a}) WHEN ({t})>=1 THEN ({b}) ELSE {byte(f'({a})+(({b})-({a}))*({t})')} END)"


def multiply(a: str, b: str) -> str:
    return f"CAST(floor(({a})*({b})/255.0e0) AS INTEGER)"


def over(t: str, u: str, alpha: str) -> str:
    w = f"({alpha})/255.0e0"
    return f"(CASE WHEN ({alpha})<=0 THEN ({u}) WHEN ({alpha})>=255 THEN ({t}) ELSE {byte(f'({t})*({w})+({u})*(1-({w}))')} END)"


def over_alpha(ta: str, ua: str) -> str:
    w = f"({ta})/255.0e0"
    return (
        f"(CASE WHEN ({ta})<=0 THEN ({ua}) WHEN ({ta})>=255 THEN ({ta}) ELSE "
        f"CAST(floor(least(255.0e0,({ta})+({ua})*(1-({w}))+0.5e0)) AS INTEGER) END)"
    )


def tint(base: str, ch: str, name: str, prefix: str = "") -> str:
    """``base`` recoloured by the biome columns gr_/fo_/wa_ + channel."""
    p = prefix
    return (
        f"(CASE WHEN {name}='grass' THEN {multiply(base, f'{p}gr_{ch}')} WHEN {name} IN ('foliage','dry') THEN {multiply(base, f'{p}fo_{ch}')} "
        f"WHEN {name}='water' THEN {multiply(base, f'{p}wa_{ch}')} ELSE ({base}) END)"
    )


def water(floor: str, wa: str, depth: str, most: float = 28.0) -> str:
    t = f"least(0.94e0,1-exp(-(CAST({depth} AS DOUBLE))/({most * 0.38!r}e0)))"
    dark = f"(1-least(1.0e0,CAST({depth} AS DOUBLE)/{most!r}e0)*0.34e0)"
    return clamp8(f"{lerp(floor, wa, t)}*{dark}")


def table(stops, ch: int) -> str:
    return "[" + ",".join(str(s[ch]) for s in stops) + "]"


def gradient(t: str, ch: int, stops=c.HEIGHT_RAMP) -> str:
    n = len(stops) - 1
    i = f"CAST(least(greatest(floor(({t})*{n}.0e0),0),{n - 1}) AS INTEGER)"
    arr = table(stops, ch)
    inner = lerp(f"({arr})[{i}+1]", f"({arr})[{i}+2]", f"({t})*{n}.0e0-{i}")
    return f"(CASE WHEN ({t})<=0 THEN {stops[0][ch]} WHEN ({t})>=1 THEN {stops[-1][ch]} ELSE {inner} END)"


def light_style(l: str, ch: int) -> str:
    caution = lerp(str(c.LIGHT_CAUTION[0][ch]), str(c.LIGHT_CAUTION[1][ch]), f"(({l})-1)/6.0e0")
    safe = lerp(str(c.LIGHT_SAFE[0][ch]), str(c.LIGHT_SAFE[1][ch]), f"(({l})-7)/8.0e0")
    return f"(CASE WHEN ({l})<=0 THEN {c.LIGHT_DARK[ch]} WHEN ({l})<=7 THEN {caution} ELSE {safe} END)"


def desaturate(ch: str, r: str, g: str, b: str, amount: str = "0.88e0") -> str:
    luma = byte(f"({r})*0.299e0+({g})*0.587e0+({b})*0.114e0")
    return lerp(ch, luma, amount)


def ore_style(base: str, best: str, score: str, ch: int) -> str:
    arr = table(c.ORE_COLORS, ch)
    ore = f"({arr})[CASE WHEN ({best})<11 THEN ({best}) ELSE 1 END+1]"
    return f"(CASE WHEN ({score})=0 THEN ({base}) ELSE {lerp(base, ore, f'least(1.0e0,({score})/16.0e0)')} END)"


def fnv(name: str) -> str:
    """64-bit FNV-1a of an ASCII expression, as UHUGEINT."""
    codes = f"list_transform(string_split({name},''), lambda ch: CAST(ascii(ch) AS UHUGEINT))"
    return (
        f"list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), {codes}), "
        "lambda h, k: (xor(h,k)*CAST(1099511628211 AS UHUGEINT))%CAST(18446744073709551616 AS UHUGEINT))"
    )


def name_color(h: str, ch: int) -> str:
    hue = f"(CAST(({h})%360 AS DOUBLE)/360.0e0)"
    sat = f"(CAST((CAST(floor(({h})//65536) AS UHUGEINT))%22 AS DOUBLE)/100.0e0+0.18e0)"
    val = f"(CAST((CAST(floor(({h})//4294967296) AS UHUGEINT))%26 AS DOUBLE)/100.0e0+0.42e0)"
    k = f"floor({hue}*6)"
    f = f"({hue}*6-{k})"
    p, q, t = f"{val}*(1-{sat})", f"{val}*(1-{f}*{sat})", f"{val}*(1-(1-{f})*{sat})"
    rows = [(val, t, p), (q, val, p), (p, val, t), (p, q, val), (t, p, val), (val, p, q)]
    cases = " ".join(f"WHEN {n} THEN ({r[ch]})" for n, r in enumerate(rows[:5]))
    return byte(f"(CASE CAST({k} AS INTEGER)%6 {cases} ELSE ({rows[5][ch]}) END)*255")


def hex_of(r: str, g: str, b: str) -> str:
    return f"('#'||printf('%02x',{r})||printf('%02x',{g})||printf('%02x',{b}))"
