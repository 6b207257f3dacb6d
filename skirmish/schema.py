"""Canonical tables of the engine and the fixed values of the event format.

One log is one recorded fight; every table carries ``log_id``.  ``seq`` is the row's place in its
log: order is part of the meaning, and all ties on time are broken by it.
"""

from __future__ import annotations

LOGS = "log_id string, build string, revision int, boss_id int"
AGENTS = (
    "log_id string, addr bigint, prof bigint, is_elite bigint, toughness int, concentration int, healing int, "
    "hitbox_width int, condition int, hitbox_height int, character string, account string, subgroup int, ord int"
)
SKILLS = "log_id string, id bigint, name string"
EVENTS = (
    "log_id string, seq bigint, time bigint, src_agent bigint, dst_agent bigint, value int, buff_dmg int, overstack bigint, "
    "skillid bigint, src_instid int, dst_instid int, src_master_instid int, dst_master_instid int, iff smallint, buff smallint, "
    "result smallint, is_activation smallint, is_buffremove smallint, is_ninety smallint, is_fifty smallint, is_moving smallint, "
    "is_statechange smallint, is_flanking smallint, is_shields smallint, is_offcycle smallint, pad bigint, x float, y float, z float"
)
#: Who takes part: side is ``squad`` or ``enemy``; rep is the first address of an account.
ROSTER = "log_id string, addr bigint, rep bigint, side string, team int, subgroup int"


class State:
    """State changes (fixed values of the format)."""

    NONE, ENTER_COMBAT, EXIT_COMBAT, UP, DEAD, DOWN, SPAWN, DESPAWN, HEALTH = 0, 1, 2, 3, 4, 5, 6, 7, 8
    LOG_START, LOG_END, WEAPON_SWAP, MAX_HEALTH, POINT_OF_VIEW = 9, 10, 11, 12, 13
    BUFF_INITIAL, POSITION, VELOCITY, FACING, TEAM, MAP_ID = 18, 19, 20, 21, 22, 25
    GUILD, BUFF_INFO, MARKER, EXTENSION, ID_TO_GUID, EXTENSION_COMBAT = 29, 30, 37, 40, 46, 49
    GROUND_MARKER, GLIDER, STUN_BREAK = 53, 55, 56
    MISSILE_CREATE, MISSILE_LAUNCH, MISSILE_REMOVE = 57, 58, 59
    ANIMATION_START, ANIMATION_STOP = 67, 68
    BUFF_APPLY, BUFF_CHANGE, BUFF_REMOVE_SINGLE, BUFF_REMOVE_ALL = 69, 70, 71, 72
    TRANSFORMATION, WVW_TEAMS, OBJECTIVE, TICK, TELEPORT = 73, 74, 75, 84, 85


class Result:
    """Results of a hit (fixed values of the format)."""

    NORMAL, CRIT, GLANCE, BLOCK, EVADE, INTERRUPT, ABSORB, BLIND, KILLING_BLOW = range(9)
    DOWNED, BREAKBAR, ACTIVATION, CROWD_CONTROL, INVERT, BUFF_CYCLE, BUFF_NOT_CYCLE = range(9, 16)
    LEECH_ON_HIT, SOURCE_ON_HIT, LEECH_ON_REMOVE = 16, 17, 18


#: Boons by id: name and whether stacks count side by side (fixed values).
BOONS = {
    740: ("Might", True), 725: ("Fury", False), 718: ("Regeneration", False), 726: ("Vigor", False),
    719: ("Swiftness", False), 717: ("Protection", False), 743: ("Aegis", False), 873: ("Resolution", False),
    1122: ("Stability", True), 1187: ("Quickness", False), 26980: ("Resistance", False), 30328: ("Alacrity", False),
}
#: Conditions by id: name, whether stacks count side by side, and how many (fixed values).
CONDITIONS = {
    720: ("Blind", False, 9), 721: ("Crippled", False, 5), 722: ("Chilled", False, 5), 723: ("Poison", True, 1500),
    727: ("Immobile", False, 3), 736: ("Bleeding", True, 1500), 737: ("Burning", True, 1500), 738: ("Vulnerability", True, 25),
    742: ("Weakness", False, 5), 791: ("Fear", False, 5), 861: ("Confusion", True, 1500), 19426: ("Torment", True, 1500),
    26766: ("Slow", False, 9), 27705: ("Taunt", False, 5),
}
CONTROLS = {872: ("Stun", False, 1), 833: ("Daze", False, 1)}
#: Skills whose hits never are critical (fixed values).
NEVER_CRITICAL = (
    9292, 9284, 5492, 13014, 30770, 52370, 31686, 56883, 56885, 29604, 28388, 13907, 29560, 13906, 13752, 22499, 21795, 43630, 45534, 10606,
)
DODGE, RESURRECT = 23275, 1066
#: From this build on, buffs and casts have state changes of their own.
BUFF_REWORK_BUILD = 20260501
