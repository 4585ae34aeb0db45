"""Constants of IEEE arithmetic."""

EPS = {"double": 2.0**-53, "single": 2.0**-24}
SAFE_MIN = {"double": 2.0**-1022, "single": 2.0**-126}
RADIX = 2.0
#: Pivots below this share of the matrix norm may be replaced.
TINY_SHARE = 2.0**-24
