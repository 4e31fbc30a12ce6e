"""Constants of the analytics profiles, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    name: str
    width: float
    height: float
    #: Confidence that players and the ball must exceed; None: no such filter.
    player_confidence: float | None
    ball_confidence: float | None
    #: "nearest" player, or "first" in detection order, within `reach` metres of the ball owns it.
    owner_rule: str
    reach: float
    #: Whether the state before a frame is that of the frame before (None without a ball) or of the last ball frame.
    state_over_ball_frames: bool
    pass_step: float
    shot_step: float
    shot_distance: float
    target_distance: float
    target_xg: float
    goal_distance: float
    xg_base: float
    xg_distance: float
    xg_angle: float
    xg_digits: int
    fouls: bool
    corner_radius: float
    #: "islands": a corner needs an event before it that is no corner; "cooldown": frames since the last corner.
    corner_rule: str
    corner_gap: int
    empty_possession: float
    pass_floor: float
    momentum_least: int
    momentum_ceil: bool
    empty_momentum_away: float
    edge_distance: float
    edge_round: bool
    accuracy_base: float
    accuracy_step: float
    node_cap: int
    edge_cap: int
    cap_before_edges: bool
    goal_text: str
    event_cap: int = 200
    zone_cap: int = 30


FIVE = Profile(
    name="five", width=42.0, height=25.0, player_confidence=None, ball_confidence=None, owner_rule="first", reach=1.0, state_over_ball_frames=False,
    pass_step=0.3, shot_step=0.8, shot_distance=12.0, target_distance=5.0, target_xg=0.15, goal_distance=1.5, xg_base=1.8, xg_distance=0.12, xg_angle=0.9, xg_digits=3,
    fouls=False, corner_radius=2.0, corner_rule="islands", corner_gap=0, empty_possession=0.0, pass_floor=0.0, momentum_least=1, momentum_ceil=False, empty_momentum_away=0.0,
    edge_distance=8.0, edge_round=False, accuracy_base=0.6, accuracy_step=0.05, node_cap=20, edge_cap=40, cap_before_edges=False, goal_text="Goal scored — xG ",
)
ELEVEN = Profile(
    name="eleven", width=105.0, height=68.0, player_confidence=0.4, ball_confidence=0.35, owner_rule="nearest", reach=3.0, state_over_ball_frames=True,
    pass_step=1.5, shot_step=3.0, shot_distance=20.0, target_distance=8.0, target_xg=0.1, goal_distance=2.0, xg_base=2.1, xg_distance=0.08, xg_angle=0.7, xg_digits=2,
    fouls=True, corner_radius=3.0, corner_rule="cooldown", corner_gap=5, empty_possession=50.0, pass_floor=0.8, momentum_least=2, momentum_ceil=True, empty_momentum_away=100.0,
    edge_distance=15.0, edge_round=True, accuracy_base=0.5, accuracy_step=0.03, node_cap=22, edge_cap=50, cap_before_edges=True, goal_text="Goal! xG: ",
)
PROFILES = {p.name: p for p in (FIVE, ELEVEN)}
