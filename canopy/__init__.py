"""PySpark-native operators for satellite pixels, spectra and wildlife telemetry."""
