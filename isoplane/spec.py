"""Settings a job carries; every check here runs before any Spark job starts."""

from dataclasses import dataclass, field, replace

import numpy as np

# Fixed values of a modelling session.
MATERN_NU = (0.5, 1.5, 2.5)
NOISE_MODELS = ("std", "sem", "constant")
CONSTANT_NOISE = 5e-2
CURVE_POINTS = 300
SURFACE_POINTS = 100
CONTOUR_LEVELS = 40
BAND_WIDTH = 1.96

# Fixed values of the design job.
DESIGN_SAMPLES = 300
DESIGN_SEED = 42
DESIGN_NOISE = 1e-6
DESIGN_LIMITS = (0.0, 100.0)
PARAMETER_BINS = 20
SCORE_BINS = 30
TOP_ROWS = 10


def ordered_union(*lists):
    """Union of column lists, first appearance first."""
    return list(dict.fromkeys(c for part in lists for c in part))


def _check_bounds(name, bounds):
    lo, hi = bounds
    if not 0 < lo < hi:
        raise ValueError(f"{name}: lower bound must be positive and below the upper bound, got {bounds}")


@dataclass(frozen=True)
class KernelConfig:
    """Covariance settings: value, search bounds and whether inputs get own scales."""

    # The defaults of the settings form.
    kernel_type: str = "rbf"
    nu: float = 1.5
    ard: bool = True
    length_scale: float | tuple = 1.0
    length_scale_bounds: tuple = (0.5, 5.0)
    constant: float = 1.0
    constant_bounds: tuple = (1e-2, 1e2)
    white_noise: bool = False
    noise_level: float = 1e-4
    noise_bounds: tuple = (1e-8, 1e-2)
    rq_alpha: float = 1.0
    rq_alpha_bounds: tuple = (1e-2, 1e2)
    #: How many of the last inputs are category codes.
    coded: int = 0

    def __post_init__(self):
        if self.kernel_type not in ("rbf", "matern", "rq"):
            raise ValueError(f"unsupported kernel type {self.kernel_type!r}")
        if self.kernel_type == "matern" and self.nu not in MATERN_NU:
            raise ValueError(f"Matern nu must be one of {MATERN_NU}")
        if self.kernel_type == "rq" and np.ndim(self.length_scale) > 0 and len(self.length_scale) > 1:
            raise ValueError("the rational quadratic kernel takes a single length scale")
        _check_bounds("length scale", self.length_scale_bounds)
        if self.white_noise:
            _check_bounds("noise level", self.noise_bounds)
        else:
            _check_bounds("constant", self.constant_bounds)
        if self.kernel_type == "rq":
            _check_bounds("rq alpha", self.rq_alpha_bounds)

    @classmethod
    def from_dict(cls, config):
        """Build from the request form's key names; nothing given means the defaults."""
        config = dict(config or {})
        names = {"length_scale_init": "length_scale", "constant_value": "constant",
                 "rq_alpha_init": "rq_alpha"}
        lo = config.pop("noise_lower", cls.noise_bounds[0])
        hi = config.pop("noise_upper", cls.noise_bounds[1])
        given = {names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in config.items()}
        return cls(noise_bounds=(lo, hi), **given)

    @classmethod
    def design_default(cls):
        """The design job's kernel: wide bounds, Matern 5/2."""
        return cls(kernel_type="matern", nu=2.5, length_scale_bounds=(1e-2, 1e2),
                   constant_bounds=(1e-3, 1e3))

    def scales(self, n_features):
        """Length scale per input."""
        return np.broadcast_to(np.asarray(self.length_scale, float), (n_features,)).copy()

    def free(self, n_features):
        """Searchable parameters as ``[(field, value, (lo, hi))]``."""
        per_input = self.ard and self.kernel_type != "rq"
        scales = self.scales(n_features)
        out = [("length_scale", float(s), self.length_scale_bounds)
               for s in (scales if per_input else scales[:1])]
        if self.white_noise:
            out.append(("noise_level", self.noise_level, self.noise_bounds))
        else:
            out.append(("constant", self.constant, self.constant_bounds))
        if self.kernel_type == "rq":
            out.append(("rq_alpha", self.rq_alpha, self.rq_alpha_bounds))
        return out

    def with_free(self, n_features, values):
        """Copy with the searchable parameters set, in the order of ``free``."""
        names = [name for name, _, _ in self.free(n_features)]
        scales = tuple(float(v) for name, v in zip(names, values) if name == "length_scale")
        rest = {name: float(v) for name, v in zip(names, values) if name != "length_scale"}
        return replace(self, length_scale=scales if len(scales) > 1 else scales[0], **rest)

    def params(self, n_features):
        """Plain values for use inside tasks."""
        return {"type": self.kernel_type, "nu": self.nu, "scales": self.scales(n_features),
                "amplitude": 1.0 if self.white_noise else self.constant,
                "white": self.noise_level if self.white_noise else 0.0, "alpha": self.rq_alpha,
                "coded": self.coded}


@dataclass(frozen=True)
class AnalysisSpec:
    """Column roles of one model.

    ``mode="std"`` summarises replicates of ``target`` first and fits their
    ``statistic`` (mean or std); ``mode="mean"`` fits every row of ``target``.
    """

    num_cols: tuple
    target: str
    cat_cols: tuple = ()
    mode: str = "std"
    statistic: str = "mean"
    log_cols: tuple = ()
    noise: str = "std"
    dropped: tuple = field(default=())

    def __post_init__(self):
        for name in ("num_cols", "cat_cols", "log_cols", "dropped"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.mode not in ("std", "mean"):
            raise ValueError("mode must be 'std' or 'mean'")
        if not self.target:
            raise ValueError("a measurement or target column is required")
        if self.mode == "std" and self.statistic not in ("mean", "std"):
            raise ValueError("statistic must be 'mean' or 'std'")
        if self.noise not in NOISE_MODELS:
            raise ValueError(f"noise must be one of {NOISE_MODELS}")
        if not self.num_cols + self.cat_cols:
            raise ValueError("at least one feature column is required")
        if self.target in self.num_cols + self.cat_cols:
            raise ValueError(f"{self.target!r} is the target and cannot be a feature")
        unknown = set(self.log_cols) - set(self.num_cols)
        if unknown:
            raise ValueError(f"log columns must be numeric features: {sorted(unknown)}")

    def with_target(self, target):
        """Change the target; it leaves both feature lists."""
        return replace(self, target=target,
                       num_cols=tuple(c for c in self.num_cols if c != target),
                       cat_cols=tuple(c for c in self.cat_cols if c != target),
                       log_cols=tuple(c for c in self.log_cols if c != target))

    def drop(self, column):
        """Leave a feature out, remembering which list it came from."""
        kind = "num" if column in self.num_cols else "cat" if column in self.cat_cols else None
        if kind is None:
            raise ValueError(f"{column!r} is not a feature")
        return replace(self, num_cols=tuple(c for c in self.num_cols if c != column),
                       cat_cols=tuple(c for c in self.cat_cols if c != column),
                       log_cols=tuple(c for c in self.log_cols if c != column),
                       dropped=self.dropped + ((column, kind),))

    def restore(self, column):
        """Bring a dropped feature back, unless it has become the target."""
        kinds = dict(self.dropped)
        if column not in kinds:
            raise ValueError(f"{column!r} was not dropped")
        if column == self.target:
            raise ValueError(f"{column!r} is the target")
        back = {"num": "num_cols", "cat": "cat_cols"}[kinds[column]]
        return replace(self, dropped=tuple(d for d in self.dropped if d[0] != column),
                       **{back: getattr(self, back) + (column,)})


def unscale_plan(mode, statistic="mean", flag=False):
    """Which outputs return to original units.

    Curves of means and of row-level targets always do and their band with
    them; a curve of replicate spread only on request. A surface always does,
    its uncertainty only on request.
    """
    value = True if mode == "mean" or statistic == "mean" else flag
    return {"curve": value, "band": value, "surface": True, "uncertainty": flag}
