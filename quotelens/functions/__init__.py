"""Column expressions.  Every function takes and returns Spark columns; none needs Python workers."""

from quotelens.functions.scalar import *  # noqa: F401,F403
from quotelens.functions.tails import chi2_sf, ks_sf  # noqa: F401
