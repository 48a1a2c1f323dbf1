"""SQL for the model queries: exact Gaussian-process algebra in recursive CTEs.

``g(i, x1.., y, nz)`` holds the support points, ``p(pid, x1..)`` the points to
predict. The covariance matrix, augmented with the identity and the target, is
reduced by Gauss-Jordan steps over nested lists.
"""

KERNELS = {
    "rbf": "exp(-0.5 * ({d2}))", "matern12": "exp(-sqrt({d2}))",
    "matern32": "(1 + sqrt(3 * ({d2}))) * exp(-sqrt(3 * ({d2})))",
    "matern52": "(1 + sqrt(5 * ({d2})) + 5 * ({d2}) / 3) * exp(-sqrt(5 * ({d2})))",
    "rq": "pow(1 + ({d2}) / 3, -1.5)",
}


def kern(kind, a, b, dims, scales=None):
    """Covariance of rows ``a`` and ``b``."""
    scales = scales or [1.0] * dims
    d2 = " + ".join(f"pow(({a}.x{k + 1} - {b}.x{k + 1}) / {s}, 2)" for k, s in enumerate(scales))
    return KERNELS[kind].format(d2=d2)


def row_points(nums, cats=(), target="l_extendedprice", constant=0.05, table="lineitem"):
    """Row mode: scaled conditions with their mean and the row noise over the count."""
    stats = ", ".join(f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in [*nums, target])
    xs = [f"({c} + 0.0 - any_value(m_{c})) / any_value(s_{c})" for c in nums]
    xs += [f"({c} = '{v}')::int::double" for c, vs in cats for v in vs]
    keys = [f"{c} + 0.0" for c in nums] + [c for c, _ in cats]
    x = ", ".join(f"{e} x{i + 1}" for i, e in enumerate(xs))
    raw = ", ".join([f"{c} + 0.0 as {c}" for c in nums] + [c for c, _ in cats])
    return f"""
    s as (select {stats} from {table}),
    g as (select row_number() over (order by {', '.join(keys)}) - 1 i, {raw}, {x},
                 avg(({target} - m_{target}) / s_{target}) y, {constant} / count(*) nz, count(*) n,
                 var_pop(({target} - m_{target}) / s_{target}) * count(*) ssw
          from {table}, s group by {', '.join(keys)})"""


def replicate_points(nums, statistic="mean", noise="sd * sd / n", target="l_extendedprice", table="lineitem"):
    """Replicate mode: scaled summary, its statistic normalised over the conditions."""
    stats = ", ".join(f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in [*nums, target])
    xs = ", ".join(f"({c} + 0.0 - any_value(m_{c})) / any_value(s_{c}) x{i + 1}" for i, c in enumerate(nums))
    raw = ", ".join(f"{c} + 0.0 as {c}" for c in nums)
    keys = ", ".join(f"{c} + 0.0" for c in nums)
    return f"""
    s as (select {stats} from {table}),
    c as (select {raw}, {xs}, avg(({target} - m_{target}) / s_{target}) mu,
                 stddev_samp(({target} - m_{target}) / s_{target}) sd, count(*) n
          from {table}, s group by {keys} having count(*) >= 2),
    nm as (select avg({'mu' if statistic == 'mean' else 'sd'}) ym,
                  stddev_pop({'mu' if statistic == 'mean' else 'sd'}) ys from c),
    g as (select row_number() over (order by {', '.join(nums)}) - 1 i, c.*,
                 ({'mu' if statistic == 'mean' else 'sd'} - ym) / ys y, {noise} nz from c, nm)"""


def solved(kind, dims, scales=None):
    """From ``g`` to the weights ``w(i, w)`` and the inverse ``ki(i, j, v)``."""
    return f"""
    k as (select a.i i, b.i j, a.y, {kern(kind, 'a', 'b', dims, scales)} + case when a.i = b.i then a.nz else 0 end v,
                 case when a.i = b.i then 1.0::double else 0.0::double end e from g a, g b),
    r0 as (select i, list(v order by j) || list(e order by j) || [any_value(y)] row_ from k group by i),
    st as (select list(row_ order by i) a, count(*) m from r0),
    gj(step, m, a, ld) as (
      select 0, m, a, 0.0::double from st
      union all
      select step + 1, m,
        list_transform(range(1, m + 1), lambda r:
          case when r = step + 1 then list_transform(a[r], lambda v: v / a[r][r])
               else list_transform(range(1, len(a[r]) + 1),
                      lambda q: a[r][q] - a[r][step + 1] / a[step + 1][step + 1] * a[step + 1][q]) end),
        ld + ln(a[step + 1][step + 1])
      from gj where step < m),
    sol as (select a, m, ld from gj where step = m),
    w as (select unnest(range(0, m)) i, unnest(list_transform(a, lambda r: r[len(r)])) w from sol),
    ki as (select i.i i, j.i j, a[i.i + 1][m + 1 + j.i] v from sol, g i, g j)"""


def inverse(name, matrix):
    """``name(i, j, v)``: the inverse of the positive matrix in CTE ``matrix(i, j, v)``, in place row by row."""
    return f"""
    {name}_r as (select i, list(v order by j) row_ from {matrix} group by i),
    {name}_s as (select list(row_ order by i) a, count(*) m from {name}_r),
    {name}_g(step, m, a) as (
      select 1, m, a from {name}_s
      union all
      select step + 1, m, list_transform(a, lambda r, n: case when n = step then top
        else list_transform(list_zip(r[:step - 1] || [0.0::double] || r[step + 1:], top), lambda z: z[1] - r[step] * z[2]) end)
      from (select step, m, a, list_transform(a[step][:step - 1] || [1.0::double] || a[step][step + 1:], lambda v: v / a[step][step]) as top
            from {name}_g where step <= m)),
    {name} as (select i.i, j.j, a[i.i + 1][j.j + 1] v from {name}_g, range(m) i(i), range(m) j(j) where step = m + 1)"""


def sparse_predicted(kind, dims, per_point=False):
    """Inducing-point predictions ``f(pid, mean, std)`` at the support points ``g``, given ``z(i, x1..)``.

    ``per_point`` adds the variance that ``z`` leaves unexplained to every point's noise.
    """
    left = ("1 - list_sum(list_transform(list_zip(kv, (select list(list_value(r) order by i) from zr)), "
            "lambda c: c[1] * list_dot_product(kv, c[2][1])))")
    return ", ".join([
        f"kzz as (select a.i, b.i j, {kern(kind, 'a', 'b', dims)} v from z a, z b)", inverse("zi", "kzz"),
        "zr as materialized (select i, list(v order by j) r from zi group by i)",
        f"kp as materialized (select g.i pid, z.i, {kern(kind, 'g', 'z', dims)} v, y, nz from g, z)",
        "kl as materialized (select pid, list(v order by i) kv from kp group by pid)",
        f"own as materialized (select pid, nz + {left if per_point else '0'} as d from kl join g on g.i = pid)",
        """kc as materialized (select i, list(v order by pid) v, list(v / d order by pid) wv, list(y order by pid) ys
             from kp join own using (pid) group by i)""",
        "ka as (select a.i, b.i j, kzz.v + list_dot_product(a.v, b.wv) as v from kc a, kc b join kzz on kzz.i = a.i and kzz.j = b.i)",
        "kb as (select i, list_dot_product(wv, ys) b from kc)", inverse("ai", "ka"),
        "w as (select ai.i, sum(ai.v * b) w from ai join kb on kb.i = ai.j group by ai.i)",
        "wl as (select list(w order by i) wl from w)",
        "d as materialized (select i, list(zi.v - ai.v order by j) r from zi join ai using (i, j) group by i)",
        """f as (select pid, any_value(list_dot_product(kv, wl)) mean, sqrt(greatest(1 - sum(kv[d.i + 1] * list_dot_product(kv, r)), 0)) std
             from kl, wl, d group by pid)"""])


def predicted(kind, dims, scales=None, with_std=True):
    """From ``p`` to ``f(pid, mean, std)`` in normalised units."""
    spread = """
    kl as materialized (select pid, list(v order by i) kv from kp group by pid),
    kr as materialized (select j, list(v order by i) r from ki group by j),
    pv as (select pid, sum(list_dot_product(kv, r) * kv[j + 1]) q from kl, kr group by pid),
    f as (select pid, m as mean, sqrt(greatest(1 - q, 0)) as std from pm join pv using (pid))"""
    return f"""
    kp as materialized (select p.pid, g.i, {kern(kind, 'p', 'g', dims, scales)} v from p, g),
    pm as (select pid, sum(v * w) m from kp join w using (i) group by pid),""" + (
        spread if with_std else " f as (select pid, m as mean, null::double as std from pm)")


def at_conditions(dims):
    """Predict at the support points themselves."""
    return "p as (select i pid, " + ", ".join(f"x{k + 1}" for k in range(dims)) + " from g)"


def statement(*ctes, select):
    return "with recursive " + ", ".join(ctes) + " " + select


def likelihoods(kind, scales):
    """Row-mode log likelihood for each single length scale, from ``g`` with one input."""
    listed = ", ".join(f"({i}, {s}::double)" for i, s in enumerate(scales))
    d2 = "pow((a.x1 - b.x1) / t.l, 2)"
    return f"""
    t(cid, l) as (values {listed}),
    k as (select t.cid, a.i i, b.i j, a.y, {KERNELS[kind].format(d2=d2)} + case when a.i = b.i then a.nz else 0 end v
          from g a, g b, t),
    r0 as (select cid, i, list(v order by j) || [any_value(y)] row_ from k group by cid, i),
    st as (select cid, list(row_ order by i) a, count(*) m from r0 group by cid),
    gj(cid, step, m, a, ld) as (
      select cid, 0, m, a, 0.0::double from st
      union all
      select cid, step + 1, m,
        list_transform(range(1, m + 1), lambda r:
          case when r = step + 1 then list_transform(a[r], lambda v: v / a[r][r])
               else list_transform(range(1, len(a[r]) + 1),
                      lambda q: a[r][q] - a[r][step + 1] / a[step + 1][step + 1] * a[step + 1][q]) end),
        ld + ln(a[step + 1][step + 1])
      from gj where step < m),
    sol as (select * from gj where step = m),
    yw as (select cid, sum(g.y * a[g.i + 1][m + 1]) v from sol, g group by cid),
    within as (select sum(ssw) ssw, sum(n) n, sum(ln(n)) ln_n from g)"""


def design_likelihoods(kind, dims, thetas):
    """``dl(cid, lml)``: row-mode log likelihood of every candidate (length scales, constant), from ``g``.

    The matrix loses its first row and column in every step; pivots and what they leave of
    the target give determinant and quadratic form.
    """
    names = [f"l{k + 1}" for k in range(dims)]
    listed = ", ".join(f"({i}, {', '.join(f'{v!r}::double' for v in t)})" for i, t in enumerate(thetas))
    d2 = " + ".join(f"pow((a.x{k + 1} - b.x{k + 1}) / t.{n}, 2)" for k, n in enumerate(names))
    return f"""
    t(cid, {', '.join(names)}, c) as (values {listed}),
    dk as (select t.cid, a.i i, b.i j, a.y, t.c * {KERNELS[kind].format(d2=d2)} + case when a.i = b.i then a.nz else 0 end v
          from g a, g b, t),
    d0 as (select cid, i, list(v order by j) || [any_value(y)] row_ from dk group by cid, i),
    dg(cid, m, a, ld, q) as (
      select cid, count(*), list(row_ order by i), 0.0::double, 0.0::double from d0 group by cid
      union all
      select cid, m, list_transform(rest, lambda r: list_transform(list_zip(r[2:], top[2:]), lambda z: z[1] - r[1] / top[1] * z[2])),
        ld + ln(top[1]), q + pow(top[len(top)], 2) / top[1]
      from (select *, a[1] as top, a[2:] as rest from dg) where len(a) > 0),
    within as (select sum(ssw) ssw, sum(n) n, sum(ln(n)) ln_n from g),
    dl as (select cid, -0.5 * q - 0.5 * ld - m / 2.0 * ln(2 * pi()) - (within.n - m) / 2.0 * ln(2 * pi() * 0.05)
             - ssw / (2 * 0.05) - 0.5 * ln_n as lml from dg, within where len(a) = 0)"""
