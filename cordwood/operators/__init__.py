"""cordwood.operators"""
