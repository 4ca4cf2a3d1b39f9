"""Reading facts and requests, writing forecasts, storing models."""
