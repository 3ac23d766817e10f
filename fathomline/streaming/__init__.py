"""No streaming operators: the data has one integer time axis (a year) and every job is a batch job."""
