"""Fixed values.

These must equal the values the reference computes with, for the results to
match; they are stated here together and used as defaults everywhere.
"""

# Preference by mean and threshold
PREFERENCE_THRESHOLD = 0.4        # a mean at or above it marks the category preferred
SHORT_SESSION_MAX_ITEMS = 20      # mean-and-threshold band: sessions of at most 20 items

# Preference by clustering
LONG_SESSION_MIN_ITEMS = 11       # clustering band: sessions of more than 10 items
KMODES_CLUSTERS = 2               # k
KMODES_MAX_ITER = 50              # default round limit
RECENT_ITEMS = 10                 # newest rows that vote for a cluster
VOTE_SHARE = 0.5                  # cluster 1 when its votes exceed this share

# Stratified sample, (shortest, longest, fraction) per length band
SAMPLE_BANDS = ((20, 30, 0.7), (31, 50, 0.8), (51, 100, 1.0))

# Notebook analyses
TOP_ITEMS = 100                   # items shown in views versus purchases
STRATUM_SESSIONS = 4              # sessions shown per stratum
