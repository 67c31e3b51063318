"""Fixed values shared by the distances and bounds."""

import math

#: A distance that is impossible, or larger than the cutoff.
INF = math.inf
#: As a window: no constraint. As a cutoff: no abandoning.
NO_WINDOW = None
#: Lower bounds by bands start a little below zero, so that rounding cannot lift them above the distance.
BAND_GUARD = -1e-14
WDTW_MAX_WEIGHT = 1.0
