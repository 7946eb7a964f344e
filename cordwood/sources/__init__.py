"""cordwood.sources"""
