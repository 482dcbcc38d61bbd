"""Correlated Gaussian samples and their settings."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import store


def covariance(sigma, dim: int) -> np.ndarray:
    """One number: sigma^2 I; a vector: diag(sigma^2); a matrix as it is, if symmetric and positive definite."""
    s = np.asarray(sigma, dtype=float)
    if s.size == 1:
        return np.eye(dim) * float(s.ravel()[0]) ** 2
    if s.ndim == 1:
        if len(s) != dim:
            raise ValueError(f"{len(s)} widths for {dim} dimensions")
        return np.diag(s**2)
    if s.shape != (dim, dim) or not np.allclose(s, s.T):
        raise ValueError("a covariance must be square and symmetric")
    if np.linalg.eigvalsh(s).min() <= 0:
        raise ValueError("a covariance must be positive definite")
    return s


def parse_settings(text: str) -> dict:
    """JSON settings with mu_nature, mu_mc, sigma_nature, sigma_mc, sigma_detector; dimensions must agree."""
    s = json.loads(text)
    need = ("mu_nature", "mu_mc", "sigma_nature", "sigma_mc", "sigma_detector")
    missing = [k for k in need if k not in s]
    if missing:
        raise ValueError(f"missing settings: {missing}")
    mu = {k: np.atleast_1d(np.asarray(s[k], dtype=float)) for k in need[:2]}
    dim = len(mu["mu_nature"])
    if len(mu["mu_mc"]) != dim:
        raise ValueError("means of different dimensions")
    return {**{k: v.tolist() for k, v in mu.items()}, **{k: covariance(s[k], dim).tolist() for k in need[2:]}, "dim": dim}


def uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) from a key: 32 bits of an md5, so that any engine can rebuild it."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(key: Column, salt: str) -> Column:
    """A standard normal from a key, by the Box-Muller transform of two hash uniforms."""
    return F.sqrt(-2 * F.log(uniform(key, f"{salt}:a"))) * F.cos(2 * math.pi * uniform(key, f"{salt}:b"))


def _affine(normals: list[Column], mean, cov) -> list[Column]:
    """mean + L n with L the lower Cholesky factor."""
    lower = np.linalg.cholesky(np.asarray(cov, dtype=float))
    out = []
    for i, row in enumerate(lower):
        total = F.lit(float(mean[i]))
        for j in range(i + 1):
            total = total + normals[j] * float(row[j])
        out.append(total)
    return out


def sample(keys: DataFrame, key: str, settings: dict, seed: int = 0) -> DataFrame:
    """row_id, y, z1.., x1..: a nature and a simulated event for each row of ``keys``.

    Truth, smearing and both classes use different hash salts.
    """
    dim = settings["dim"]
    out = None
    for y, name in ((1, "nature"), (0, "mc")):
        truth = [normal(F.col(key), f"{seed}:{name}:z{i}") for i in range(dim)]
        noise = [normal(F.col(key), f"{seed}:{name}:x{i}") for i in range(dim)]
        z = _affine(truth, settings[f"mu_{name}"], settings[f"sigma_{name}"])
        shift = _affine(noise, [0.0] * dim, settings["sigma_detector"])
        part = keys.select(
            F.concat_ws(":", F.lit(name), F.col(key).cast("string")).alias("row_id"), F.lit(y).alias("y"),
            *[c.alias(f"z{i + 1}") for i, c in enumerate(z)], *[(c + s).alias(f"x{i + 1}") for i, (c, s) in enumerate(zip(z, shift))],
        )
        out = part if out is None else out.unionByName(part)
    return out


def generate(spark: SparkSession, n: int, settings: dict, seed: int = 0) -> DataFrame:
    return sample(spark.range(n), "id", settings, seed)


def dataset(spark: SparkSession, folder: str, n: int, settings: dict, seed: int = 0) -> DataFrame:
    """``generate``, kept as a table in ``folder`` under a name that follows from n, settings and seed."""
    return store.cached(spark, folder, {"kind": "gaussian", "n": n, "seed": seed, "settings": settings}, lambda: generate(spark, n, settings, seed))


def cubic_response(z: Column, strength: float | Column) -> Column:
    """Deterministic detector response z + s z^3."""
    return z + strength * z * z * z
