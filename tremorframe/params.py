"""Run parameters with every default stated."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from typing import Any, Optional


@dataclass(frozen=True)
class RunParams:
    """All knobs of preparation, relocation and sampling.

    Filters are off unless asked for: bounds of ``None`` and thresholds of 0 skip their step.
    """

    lat_min: float
    lon_min: float

    station_file: Optional[str] = None
    catalog_infile: Optional[str] = None
    dtime_file: Optional[str] = None
    catalog_outfile: Optional[str] = None
    samples_outfile: Optional[str] = None
    checkpoint_dir: Optional[str] = None
    metrics_outfile: Optional[str] = None
    config_outfile: Optional[str] = None

    evid_type: str = "auto"
    event_lat_bounds: Optional[tuple[float, float]] = None
    event_lon_bounds: Optional[tuple[float, float]] = None
    remove_duplicates: bool = False
    max_abs_input_dt: float = 0.0
    dtime_thin_frac: float = 1.0
    # exactly that share of the rows, instead of each row with that chance
    dtime_thin_exact: bool = False
    thin_seed: int = 42
    flip_dt_sign: bool = False
    cc_min: float = 0.0
    min_dtimes_per_pair: int = 0
    min_dtimes: int = 0

    vp: float = 6.0
    vs: float = 3.3
    scale: float = 400.0

    phase_unc: tuple[float, float] = (0.01, 0.01)
    prior_event_std: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.10)
    prior_centroid_std: tuple[float, float, float, float] = (0.01, 0.01, 0.01, 0.01)

    phase1_epochs: int = 0
    phase2_epochs: int = 0
    phase3_epochs: int = 500
    phase4_epochs: int = 0
    lr_warmup: float = 2e-3
    lr_sgld: float = 1e-3
    batch_size_warmup: Optional[int] = None
    batch_size_sgld: Optional[int] = None
    sgld_beta: float = 0.99
    sgld_eps: float = 1e-5
    sgld_preconditioning: bool = True
    sgld_preconditioner: str = "rmsprop"
    noise_seed: int = 0

    save_every_n: int = 10
    samples_store_lonlat: bool = True
    checkpoint_interval: int = 50
    metrics_every: int = 10
    catalog_every: int = 100
    rel_change_window: int = 10
    rel_change_window2: int = 50
    reset_batch_numbers: bool = False
    clear_samples_on_reset: bool = False

    @staticmethod
    def from_dict(raw: dict[str, Any]) -> "RunParams":
        """Build from a parsed parameter file; keys this library has no use for are ignored."""
        known = {f.name for f in fields(RunParams)}
        missing = [k for k in ("lat_min", "lon_min") if k not in raw]
        if missing:
            raise KeyError(f"parameters lack required keys {missing}")
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known}
        return RunParams(**kept)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)
