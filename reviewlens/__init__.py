"""reviewlens: unsupervised anomaly analytics for review-style tables on Spark.

Subpackages
-----------
functions  scalar column expressions (helpfulness ratio, day offsets, labels)
sources    table scans, catalogs, synthetic data, model / result stores
operators  relational and model operators (prepare, profile, detectors, ...)
plans      end-to-end plans bound to the driver's test tables
streaming  stateless scoring of a stream with a stored model
"""

__version__ = "0.1.0"
