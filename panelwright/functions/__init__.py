"""Scalar functions that neither engine has: distribution tails and portable draws."""
