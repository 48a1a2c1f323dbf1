import numpy as np
import pytest

from isoplane.spec import AnalysisSpec, KernelConfig, ordered_union, unscale_plan


def test_kernel_defaults_and_request_names():
    k = KernelConfig.from_dict(None)
    assert (k.kernel_type, k.length_scale_bounds, k.constant_bounds, k.nu) == ("rbf", (0.5, 5.0), (1e-2, 1e2), 1.5)
    k = KernelConfig.from_dict({"kernel_type": "matern", "nu": 2.5, "length_scale_init": 2, "length_scale_bounds": [2, 10],
                                "white_noise": True, "noise_level": 1e-3, "noise_lower": 1e-6, "noise_upper": 1e-1})
    assert k.length_scale_bounds == (2, 10) and k.noise_bounds == (1e-6, 1e-1) and k.noise_level == 1e-3
    assert KernelConfig.from_dict({"rq_alpha_init": 2.0, "kernel_type": "rq", "constant_value": 3.0}).constant == 3.0
    d = KernelConfig.design_default()
    assert (d.nu, d.length_scale_bounds, d.constant_bounds) == (2.5, (1e-2, 1e2), (1e-3, 1e3))


@pytest.mark.parametrize("bad", [
    {"kernel_type": "linear"}, {"kernel_type": "matern", "nu": 2.0}, {"length_scale_bounds": (2.0, 2.0)},
    {"constant_bounds": (0.0, 1.0)}, {"white_noise": True, "noise_bounds": (1.0, 0.1)},
    {"kernel_type": "rq", "rq_alpha_bounds": (3, 2)}, {"kernel_type": "rq", "length_scale": (1.0, 2.0)}])
def test_bad_kernels(bad):
    with pytest.raises(ValueError):
        KernelConfig(**bad)


def test_free_parameters():
    names = [n for n, _, _ in KernelConfig().free(3)]
    assert names == ["length_scale"] * 3 + ["constant"]
    assert [n for n, _, _ in KernelConfig(ard=False).free(3)] == ["length_scale", "constant"]
    assert [n for n, _, _ in KernelConfig(kernel_type="rq", white_noise=True).free(3)] == [
        "length_scale", "noise_level", "rq_alpha"]
    k = KernelConfig().with_free(3, [1, 2, 3, 4])
    assert k.length_scale == (1, 2, 3) and k.constant == 4
    assert np.allclose(k.scales(3), [1, 2, 3])


def test_roles():
    spec = AnalysisSpec(["a", "b"], "y", cat_cols=["c"], log_cols=["a"])
    assert spec.with_target("a").num_cols == ("b",) and spec.with_target("a").log_cols == ()
    dropped = spec.drop("b").drop("c")
    assert (dropped.num_cols, dropped.cat_cols) == (("a",), ())
    assert dropped.restore("c").cat_cols == ("c",) and dropped.restore("b").num_cols == ("a", "b")
    with pytest.raises(ValueError, match="target"):
        spec.drop("b").with_target("b").restore("b")
    with pytest.raises(ValueError):
        spec.drop("zzz")
    with pytest.raises(ValueError):
        spec.restore("a")
    assert ordered_union(["a", "b"], ["b", "c"]) == ["a", "b", "c"]


@pytest.mark.parametrize("bad", [
    dict(num_cols=[], target="y"), dict(num_cols=["a"], target=""), dict(num_cols=["a"], target="a"),
    dict(num_cols=["a"], target="y", mode="x"), dict(num_cols=["a"], target="y", statistic="max"),
    dict(num_cols=["a"], target="y", noise="none"), dict(num_cols=["a"], target="y", log_cols=["b"])])
def test_bad_specs(bad):
    with pytest.raises(ValueError):
        AnalysisSpec(**bad)


def test_unscale_rules():
    assert unscale_plan("std", "mean") == {"curve": True, "band": True, "surface": True, "uncertainty": False}
    assert unscale_plan("std", "std")["curve"] is False and unscale_plan("std", "std", True)["curve"] is True
    assert unscale_plan("mean", flag=True) == {"curve": True, "band": True, "surface": True, "uncertainty": True}
