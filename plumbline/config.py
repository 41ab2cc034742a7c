"""Thresholds of all detectors, from defaults and TOML."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field

# The defaults are part of the detectors' meaning.


@dataclass(frozen=True)
class Function:
    cc_warning: int = 9
    cc_alert: int = 18
    cogc_warning: int = 15
    cogc_alert: int = 25
    loc_warning: int = 65
    loc_alert: int = 100
    nesting_depth: int = 4
    bump_count: int = 2
    arg_max: int = 5
    constructor_arg_max: int = 8
    compound_conditions: int = 2
    embedded_block_loc: int = 15
    asserts_max: int = 10
    primitive_ratio: float = 0.7
    primitive_min_typed: int = 4
    primitive_min_same: int = 2
    injection_min: int = 4
    framework_injection_min: int = 8
    short_var_min_loc: int = 15
    short_var_max: int = 3
    match_arms_max: int = 5
    dup_assert_min: int = 6


@dataclass(frozen=True)
class Module:
    loc_warning: int = 500
    loc_alert: int = 700
    functions: int = 20
    total_cc: int = 100
    declarations: int = 20
    large_fn_loc: int = 40
    large_fn_count: int = 3
    struct_fields: int = 12
    global_conditionals: int = 0
    global_nesting: int = 3
    lcom4: int = 3
    dup_min_loc: int = 6
    dup_skeleton_loc: int = 20
    dup_min_group: int = 2
    dup_min_kinds: int = 3


@dataclass(frozen=True)
class History:
    max_commit_files: int = 40
    min_support: int = 3
    min_confidence: float = 0.5
    min_lift: float = 1.0
    build_min_ratio: float = 0.5
    hotspot_min_revisions: int = 3
    hotspot_min_score: int = 30
    hotspot_top: int = 10
    minor_pct: float = 5.0
    min_minor_authors: int = 3
    min_total_commits: int = 5
    blob_commit_pct: float = 0.08
    shotgun_confidence: float = 0.70
    shotgun_packages: int = 3
    szz_min_inducing: int = 3
    szz_max_fixes: int = 150
    entropy_bits: float = 2.0
    top: int = 20


@dataclass(frozen=True)
class Graph:
    damping: float = 0.85
    max_iterations: int = 100
    epsilon: float = 1e-6
    distance_warning: float = 0.7
    distance_alert: float = 0.85
    min_coupling: int = 3
    cycle_min_size: int = 2
    unstable_strength: float = 0.30
    hub_imbalance: float = 0.25
    god_percentile: float = 0.90
    resolution: float = 1.0
    passes: int = 20
    min_split_files: int = 4
    split_cohesion: float = 0.6
    fragment_files: int = 8
    fragment_density: float = 1.5
    fragment_loc: int = 80
    min_modules: int = 5
    top: int = 50


@dataclass(frozen=True)
class Named:
    shotgun_classes: int = 5
    shotgun_methods: int = 10
    shotgun_fanout: int = 5
    divergent_classes: int = 6
    divergent_fanout: int = 6
    divergent_methods: int = 5
    envy_atfd: int = 5
    envy_ratio: float = 0.6
    envy_locality: float = 0.5
    god_wmc: int = 47
    god_tcc: float = 0.33
    god_atfd: int = 5
    parallel_overlap: int = 3
    bequest_enabled: bool = False
    bequest_ratio: float = 0.3
    bequest_methods: int = 3
    cohesion_methods: int = 5
    cohesion_vocabulary: int = 12
    cohesion_min: float = 0.10
    anomaly_classes: int = 8
    anomaly_distance: float = 11.143
    anomaly_top: int = 10
    call_targets: int = 4
    top: int = 50


@dataclass(frozen=True)
class Mining:
    min_support: int = 5
    min_depth: int = 3
    min_nodes: int = 5
    idiom_share: float = 0.5
    top: int = 25
    zscore: float = 3.0
    features_failed: int = 2
    min_bytes: int = 200
    distinct_kinds: int = 2
    branching: float = 0.5
    gain_floor: float = 0.0
    clone_distance: int = 12
    clone_cluster: int = 2
    clone_window_pct: int = 30
    clone_min_loc: int = 6
    ngram_order: int = 6
    ngram_cache: int = 5000
    ngram_gamma: float = 1.0
    ngram_tokens: int = 20
    ngram_zscore: float = 3.0
    natural_functions: int = 10
    ifdef_min: int = 40
    ifdef_top: int = 12
    any_min: int = 8
    reflexion_top: int = 20
    freshness_missed: int = 5
    freshness_years: int = 2
    freshness_top: int = 30
    taint_visits: int = 2
    taint_depth: int = 16
    taint_top: int = 50


@dataclass(frozen=True)
class Thresholds:
    function: Function = field(default_factory=Function)
    module: Module = field(default_factory=Module)
    history: History = field(default_factory=History)
    graph: Graph = field(default_factory=Graph)
    named: Named = field(default_factory=Named)
    mining: Mining = field(default_factory=Mining)


DEFAULTS = Thresholds()


@dataclass(frozen=True)
class Config:
    thresholds: Thresholds = DEFAULTS
    by_language: dict[str, Thresholds] = field(default_factory=dict)
    disabled: frozenset[str] = frozenset()
    ignore: tuple[str, ...] = ()


def _apply(base: Thresholds, values: dict) -> Thresholds:
    """base with values by name of group and threshold; unknown thresholds are passed over, as a newer file may have them."""
    groups = {}
    for group, own in values.items():
        if isinstance(own, dict) and hasattr(base, group):
            known = {f.name for f in dataclasses.fields(getattr(base, group))}
            groups[group] = dataclasses.replace(getattr(base, group), **{k: v for k, v in own.items() if k in known})
    return dataclasses.replace(base, **groups)


def load(text: str) -> Config:
    """A configuration from TOML: [thresholds.<group>], [languages.<name>.<group>], [disable] smells, [ignore] paths. Other top-level keys are an error."""
    data = tomllib.loads(text)
    unknown = set(data) - {"thresholds", "languages", "disable", "ignore", "audit", "history"}
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    base = _apply(DEFAULTS, data.get("thresholds", {}))
    base = _apply(base, {"history": data.get("history", {}), "mining": data.get("audit", {})})
    languages = {name: _apply(base, own) for name, own in data.get("languages", {}).items()}
    return Config(base, languages, frozenset(data.get("disable", {}).get("smells", [])), tuple(data.get("ignore", {}).get("paths", [])))
