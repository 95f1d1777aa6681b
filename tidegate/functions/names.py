"""Roles of channels by their names."""

from __future__ import annotations

import re

#: Prefixes that give a role, the form of a flow tag, endings of commands.
_CONTINUOUS, _DISCRETE = ("L_", "F_", "P_"), ("S_",)
_FLOW_TAG = re.compile(r"F(IT|T|IC)?\d*Z?")
_COMMANDS = {"CO", "SP"}


def role_by_name(channel: str) -> str | None:
    """continuous or discrete where the name's prefix says so."""
    if channel.startswith(_CONTINUOUS):
        return "continuous"
    return "discrete" if channel.startswith(_DISCRETE) else None


def is_flow(channel: str) -> bool:
    """A measured flow: one part of the name is a flow tag, and the name is not that of a command."""
    *rest, last = channel.upper().split("_")
    return last not in _COMMANDS and any(_FLOW_TAG.fullmatch(part) for part in [*rest, last])


def is_analyser(channel: str) -> bool:
    """Analysers (AIT anywhere in the name) are kept from the detector."""
    return "AIT" in channel.upper()
