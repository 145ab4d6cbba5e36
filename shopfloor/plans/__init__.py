"""Plans that combine operators: dataset builders and the refresh job."""
