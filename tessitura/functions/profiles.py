"""Key profiles and the 24 x 12 template they fold into.

The score of a key is the mean of four Pearson correlations with rotated profiles. Each is a dot product of
two standardised vectors, so the mean is one dot product with the mean of the standardised profiles.
"""

from __future__ import annotations

import functools

import numpy as np

#: By scale degree: Krumhansl, Temperley, electronic dance and learned, each major then minor.
DEGREES = (
    ((6.35, 6.33), (5.0, 5.0), (6.8, 6.6), (0.0972, 0.0972)),
    ((2.23, 2.68), (2.0, 2.0), (3.0, 3.2), (0.0776, 0.0815)),
    ((3.48, 3.52), (3.5, 3.5), (4.2, 4.0), (0.0833, 0.0815)),
    ((2.33, 5.38), (2.0, 4.5), (2.8, 5.4), (0.0754, 0.0825)),
    ((4.38, 2.6), (4.5, 2.0), (5.6, 3.0), (0.085, 0.0745)),
    ((4.09, 3.53), (4.0, 4.0), (4.4, 4.2), (0.0818, 0.0798)),
    ((2.52, 2.54), (2.0, 2.0), (2.6, 2.8), (0.0749, 0.0754)),
    ((5.19, 4.75), (4.5, 4.5), (5.8, 5.2), (0.0922, 0.0917)),
    ((2.39, 3.98), (2.0, 3.5), (3.2, 4.4), (0.0743, 0.0808)),
    ((3.66, 2.69), (3.5, 2.0), (4.4, 3.0), (0.0804, 0.0769)),
    ((2.29, 3.34), (1.5, 1.5), (2.4, 3.6), (0.0766, 0.083)),
    ((2.88, 3.17), (4.0, 4.0), (3.8, 3.6), (0.0831, 0.0819)),
)


@functools.cache
def template() -> np.ndarray:
    """[24, 12]: row tonic + 12 * minor; a chroma's score is row @ ((chroma - mean) / norm)."""
    p = np.array(DEGREES, np.float64).transpose(1, 2, 0)  # family, mode, degree
    p = p - p.mean(2, keepdims=True)
    p = (p / np.linalg.norm(p, axis=2, keepdims=True)).mean(0)
    out = np.array([np.roll(p[mode], tonic) for mode in (0, 1) for tonic in range(12)])
    out.setflags(write=False)
    return out
