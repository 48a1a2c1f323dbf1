import pytest

from isoplane.plans import requests

BASE = {"mode": "both", "std_num_cols": ["a", "b"], "std_cat_cols": ["c"], "measurement_col": "y", "std_gp_target": "mean",
        "std_noise": "constant", "std_log_vars": ["b"], "mean_num_cols": ["a", "b"], "mean_cat_cols": ["c"],
        "mean_output_col": "y", "mean_log_vars": ["b"],
        "std_kernel_config": {"kernel_type": "matern", "nu": 1.5, "length_scale_bounds": [2, 10]}}


@pytest.fixture(scope="module")
def df(spark):
    rows = [(float(a), float(b), c, a * 0.5 + b + r * 0.1 + (c == "u")) for a in range(3) for b in (1, 10, 100)
            for c in "uv" for r in range(3)]
    return spark.createDataFrame(rows, "a double, b double, c string, y double")


@pytest.fixture(scope="module")
def fitted(df):
    return requests.fit_request(df, BASE, tune=False)


def test_response(fitted, df):
    rows = {r["mode"]: r for r in requests.response_table(fitted, df).collect()}
    assert rows["std"]["target"] == "mean" and rows["mean"]["target"] == "y"
    assert rows["std"]["control_vars"] == ["a", "b", "c_u", "c_v"] and rows["mean"]["combos"] == ["c=u", "c=v"]
    assert all(0 < r["r2"] <= 1 and r["mae"] == round(r["mae"], 4) for r in rows.values())
    assert fitted["std"].conditions is fitted["mean"].conditions
    assert requests.axis_choices(fitted) == {"num_cols": ["a", "b"], "log_cols": ["b"]}


@pytest.mark.parametrize("mode", ["std", "mean", "both"])
def test_plots(fitted, df, mode):
    one = requests.plot_request(fitted, {"mode": mode, "plot_type": "1d", "x_var": "b"}, df)
    assert one["curve"].count() == 900
    two = requests.plot_request(fitted, {"mode": mode, "plot_type": "2d", "x_var": "a", "y_var": "b"}, df)
    assert two["surface"].count() == 10_000
    kept = {m: t.count() for m, t in two["scatter"].items()}
    assert kept == {m: n for m, n in {"std": 18, "mean": 54}.items() if mode in (m, "both")}


def test_single_mode_and_errors(df, fitted):
    only = requests.fit_request(df, {**BASE, "mode": "mean"}, tune=False)
    assert list(only) == ["mean"]
    with pytest.raises(ValueError, match="fit it first"):
        requests.plot_request(only, {"mode": "both", "x_var": "a"}, df)
    with pytest.raises(ValueError, match="mode must be"):
        requests.fit_request(df, {"mode": "all"})
    with pytest.raises(ValueError, match="required"):
        requests.fit_request(df, {"mode": "std", "std_num_cols": ["a"]})
