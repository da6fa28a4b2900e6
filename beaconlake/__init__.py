"""beaconlake: a Spark-native engine for short, noisy, timestamped messages and their archive."""
