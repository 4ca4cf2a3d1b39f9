"""DataFrame-to-DataFrame steps; none of them triggers a job."""
