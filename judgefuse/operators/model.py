"""Model parameters (H6) and the per-step log-likelihood expressions shared by
scoring (H5, H7), case aggregation (E8, E9) and the EM fit (H2).

Parameters are a handful of numbers; they enter plans as literals so Catalyst
folds them and whole-stage codegen evaluates the posterior in place.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
CHANNELS = ("E_gui", "E_code", "E_noresp")


@dataclass
class EMParams:
    """Mixture parameters for K causes (cause 0 is the environment cause)."""

    causes: list[str]
    p_delta: list[float]
    theta: list[list[float]]          # K x 3 (gui, code, noresp)
    psi: list[float]

    @property
    def k(self) -> int:
        return len(self.causes)

    @property
    def agent_causes(self) -> list[int]:
        return list(range(1, self.k))

    def to_dict(self) -> dict:
        return {
            "P_delta": {c: float(p) for c, p in zip(self.causes, self.p_delta)},
            "theta": {c: {ch: float(v) for ch, v in zip(CHANNELS, row)}
                      for c, row in zip(self.causes, self.theta)},
            "psi": {c: float(p) for c, p in zip(self.causes, self.psi)},
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    @classmethod
    def from_dict(cls, d: dict, causes: list[str] | None = None) -> "EMParams":
        causes = list(causes or d["P_delta"].keys())
        for part in ("P_delta", "theta", "psi"):
            missing = [c for c in causes if c not in d[part]]
            if missing:
                raise ValueError(f"params.{part} lacks causes {missing}")
        for c in causes:
            missing = [ch for ch in CHANNELS if ch not in d["theta"][c]]
            if missing:
                raise ValueError(f"params.theta.{c} lacks channels {missing}")
        return cls(causes=causes,
                   p_delta=[float(d["P_delta"][c]) for c in causes],
                   theta=[[float(d["theta"][c][ch]) for ch in CHANNELS] for c in causes],
                   psi=[float(d["psi"][c]) for c in causes])

    @classmethod
    def from_json(cls, text: str, causes: list[str] | None = None) -> "EMParams":
        return cls.from_dict(json.loads(text), causes)

    @classmethod
    def two_cause(cls, pi, theta_env, theta_agent, psi) -> "EMParams":
        return cls(["EnvFail", "AgentFail"], list(pi), [list(theta_env), list(theta_agent)],
                   list(psi))


@dataclass
class ChannelWeights:
    """Channel weights used by the EM fit (H2) and step posterior (H5)."""

    w_gui: float = 1.0
    w_code: float = 1.0
    w_noresp: float = 0.5
    agent_weight: float = 0.9

    @property
    def w(self) -> list[float]:
        return [self.w_gui, self.w_code, self.w_noresp]


# Values used by the reference's command-line training and prediction runs.
RUN_WEIGHTS = ChannelWeights(w_gui=1.0, w_code=1.2, w_noresp=0.3, agent_weight=0.9)


def bern_log(e: Column, p: float, eps: float = EPS) -> Column:
    """log P(e | p) for binary e with the additive eps of the reference."""
    return F.when(e == F.lit(1.0), F.lit(math.log(p + eps))) \
        .otherwise(F.lit(math.log(1.0 - p + eps)))


def step_base_logits(params: EMParams, weights: list[float] | None,
                     e: list[Column], m: list[Column] | None) -> list[Column]:
    """Per-cause Σ_j w_j·(1−M_j)·log P(E_j | θ_dj) — the evidence part of H2/H5.

    ``m=None`` means masks are not applied (the fit's default, Q4);
    ``weights=None`` means unit weights (case_bayes, E9).
    """
    out = []
    for d in range(params.k):
        terms = []
        for j in range(3):
            t = bern_log(e[j], params.theta[d][j])
            if m is not None:
                t = F.when(m[j] == F.lit(1), F.lit(0.0)).otherwise(t)
            if weights is not None:
                t = F.lit(float(weights[j])) * t
            terms.append(t)
        out.append(terms[0] + terms[1] + terms[2])
    return out


def agent_logit(params: EMParams, d: int, c_value: float, agent_weight: float) -> float:
    """Agent channel constant for cause d when the case verdict is c_value."""
    psi = min(max(params.psi[d], 1e-4), 1 - 1e-4)
    return agent_weight * (c_value * math.log(psi) + (1 - c_value) * math.log(1 - psi))


def softmax_eps(logits: list[Column], eps: float = EPS) -> tuple[list[Column], Column]:
    """Max-shifted softmax; returns (posteriors, log normaliser) as in H2/H5."""
    mx = F.greatest(*logits) if len(logits) > 1 else logits[0]
    lse = mx + F.log(sum((F.exp(l - mx) for l in logits[1:]), F.exp(logits[0] - mx)) + F.lit(eps))
    return [F.exp(l - lse) for l in logits], lse
