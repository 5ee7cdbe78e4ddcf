"""Job parameters as a frozen record; fitted knobs become literal columns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StrengthConfig:
    """Knobs of strength estimation and prediction.

    Decay rates play the part of persistence priors: the mean of Beta(a, b) is a / (a + b).
    """

    # Estimation: how fast old rounds fade, pooling weights in goals, sweeps and replicates.
    decay: float = 29.0 / 30.0
    ability_decay: float = 49.0 / 50.0
    form_decay: float = 8.0 / 9.0
    use_form_decomposition: bool = False
    prior_weight: float = 5.0
    home_prior_weight: float = 20.0
    steps: int = 200
    tolerance: float = 1e-10
    replicates: int = 20
    seed: int = 42
    # Training-form predictor: expected-goals term and soft clip of the log rate.
    use_xg: bool = False
    xg_weight: float = 1.0
    use_opponent_adjusted_xg: bool = False
    xg_adjustment_strength: float = 0.3
    clip_theta: float = 2.0
    # Predictions: score grid (None: as far as the rates need), listed scores, optional thinning.
    max_goals: int | None = None
    top_scores: int = 10
    sample_draws: int | None = None

    @property
    def fit_decay(self) -> float:
        """Ability plus form is the fast fit, so decomposed strengths follow the form's decay."""
        return self.form_decay if self.use_form_decomposition else self.decay
