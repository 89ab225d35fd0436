"""Matrix factorisation and what goes with it, on Spark DataFrames."""

import os

# tasks and the driver's small matrices gain nothing from BLAS threads, which fight with Spark's
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")
