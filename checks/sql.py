"""Text helpers for the checking SQL."""

from __future__ import annotations


def R(x: str, n: int) -> str:
    return f"(round_even(({x})*1e{n}, 0)/1e{n})"


def FIX(x: str, n: int) -> str:
    return f"printf('%.{n}f', {R(x, n)})"


def MOD360(x: str) -> str:
    return f"(((({x}) % 360e0) + 360e0) % 360e0)"


def ANG(a: str, b: str) -> str:
    return f"abs({MOD360(f'({a}) - ({b}) + 180e0')} - 180e0)"


def HAV(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    s1, s2 = f"sin(radians(({lat2})-({lat1}))/2)", f"sin(radians(({lon2})-({lon1}))/2)"
    a = f"({s1}*{s1} + cos(radians({lat1}))*cos(radians({lat2}))*{s2}*{s2})"
    return f"(6371e0*(2e0*atan2(sqrt({a}), sqrt(1e0-{a}))))"


def HOURS(later: str, earlier: str) -> str:
    return f"((epoch_us({later})-epoch_us({earlier}))/3.6e9)"
